"""Training-data operators over Spark tables.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.  Every
module holds one operator with a general interface; :mod:`larkspur.llm.queries`
derives the registered digest queries from those operators.
"""
