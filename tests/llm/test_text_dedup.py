import hashlib
import random

import pytest
from pyspark.sql import functions as F

from larkspur.llm import lines, substrings


def brute_windows(rows, length):
    """(n_words, kept words) by row, in the order of (id, text)."""
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - length + 1):
            key = tuple(words[i : i + length])
            if key in seen:
                gone.update(range(i, i + length))
            seen.add(key)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdef") * rng.randint(1, 2)
    passage = [word() for _ in range(60)]
    out = []
    for i in range(60):
        words = [word() for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            a = rng.randrange(30)
            words[10:10] = passage[a : a + rng.randint(5, 40)]
        out.append((i * 7 % 61, " ".join(words)))
    return out + [(100, None), (101, ""), (102, " ".join(passage)), (103, " ".join(passage)), (104, "x " * 3000), (105, "x"), (106, "x")]


@pytest.mark.parametrize("length", [3, 7, 20])
def test_windows_match_brute_force(spark, length):
    rows = corpus(length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(docs, length, texts=True).collect()
    assert sorted([tuple(r)[:4] for r in got], key=str) == brute_windows(rows, length)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_windows_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (1, "q a b c"), (2, "a b c")]
    docs = spark.createDataFrame([(*r, 9, "k") for r in rows], "doc_id long, text string, key int, copy string")
    got = sorted((tuple(r) for r in substrings.remove_repeats(docs, 3).collect()), key=str)
    assert got == brute_windows(rows, 3)
    assert substrings.remove_repeats(docs.where("false")).count() == 0


def brute_lines(rows, min_lines, min_chars):
    single, runs, out = set(), set(), {}
    for doc, text in sorted(rows):
        own = (text or "").split("\n")
        gone = {i for i, x in enumerate(own) if x in single and len(x) >= min_chars}
        single.update(own)
        for i, x in enumerate(own):
            if own.index(x) < i and len(x) >= min_chars:
                gone.add(i)
        for i in range(len(own) - min_lines + 1):
            key = tuple(own[i : i + min_lines])
            if key in runs:
                gone.update(range(i, i + min_lines))
            runs.add(key)
        out[doc] = (len(own), len(gone), "\n".join(x for i, x in enumerate(own) if i not in gone))
    return out


@pytest.mark.parametrize("min_lines,min_chars", [(2, 6), (3, 50), (4, 4), (5, 3)])
def test_lines_match_brute_force(spark, min_lines, min_chars):
    rng = random.Random(min_lines)
    rows = [(i, "\n".join(rng.choice(["", "a", "bb", "a longer line", "another long line", "é", f"own {i}"]) for _ in range(rng.randint(1, 12)))) for i in range(80)]
    rows += [(200, ""), (201, "\n\n\n\n\n\n"), (202, "same\n" * 900)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, mask string, removed int").repartition(3)
    got = lines.remove_repeated_lines(docs, min_lines=min_lines, min_chars=min_chars)
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got.collect()} == brute_lines(rows, min_lines, min_chars)


def test_lines_of_null_texts_and_ids(spark):
    docs = spark.createDataFrame([(1, None), (None, "a line that is long enough"), (2, "a line that is long enough"), (2, "a line that is long enough")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.remove_repeated_lines(docs).collect()), key=str)
    assert got == sorted([(1, None, 0, 0), (None, "a line that is long enough", 1, 0), (2, "", 1, 1), (2, "", 1, 1)], key=str)
    assert lines.remove_repeated_lines(docs.where("false")).count() == 0


def test_suffix_ranks_follow_the_order_of_line_ids(spark):
    docs = spark.createDataFrame([(1, "a\nb\na\nb\nc"), (2, "b\na\nb\nc")], "_key long, text string")
    table = lines.line_table(docs, "text", "_key")
    ids = {(r.key, r.pos): r.id for r in table.collect()}
    _, deep = lines.suffix_ranks(table, 3)
    got = sorted(deep.collect(), key=lambda r: r["rank"])
    suffix = lambda r: [ids[(r.key, r.pos + k)] for k in range(3)]
    assert [suffix(r) for r in got] == sorted(suffix(r) for r in got) and {(r.key, r.pos, r.later) for r in got} == {(1, 1, False), (1, 2, False), (2, 0, True), (2, 1, True)}
    assert deep.select(F.count_distinct("rank")).first()[0] == 2


def test_doubling_goes_on_until_no_suffix_repeats(spark):
    run = "\n".join(f"l{i}" for i in range(21))
    docs = spark.createDataFrame([(1, run), (2, "x\n" + run + "\ny"), (3, "l3\nl4\nl5\nl6\nq\nl9\nl10\nl11\nl12")], "_key long, text string")
    table = lines.line_table(docs, "text", "_key")
    levels = [(depth, level.count()) for depth, level in lines.suffix_levels(table, 3)]
    assert [d for d, _ in levels] == [1, 2, 3, 6, 12] and levels[-1][1] == 2 * (21 - 12 + 1)
    got = {(r.key, r.start, r.stop) for r in lines.repeated_runs(table, 4, 50).collect()}
    assert got == {(2, 1, 22), (3, 0, 4), (3, 5, 9)}
    assert lines.repeated_runs(table.where("false")).count() == 0


def test_lines_leave_columns_of_any_name(spark):
    rows = [(i, "the same long line of text here\nown", "a", 5, [1], 3) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _lines string, mask_key int, _key array<int>, n_lines int")
    got = lines.remove_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "_lines", "mask_key", "_key", "n_lines", "n_removed"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()][1] == (1, "own", "a", 5, [1], 2, 1)


def test_a_passage_of_very_many_documents_is_remembered_by_its_task(spark, monkeypatch):
    from larkspur.llm import common

    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(400):
        words = [f"{rng.randrange(50)}w" for _ in range(rng.randint(0, 12))]
        cut = rng.randrange(5)
        rows.append((i * 37 % 400, " ".join(words + passage[cut : cut + 24] + words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    small = lambda batches, column, rows=7, size=0: common.slices(batches, column, 7)
    monkeypatch.setattr(substrings, "slices", small)
    got = substrings.remove_repeats(docs, 10).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_windows(rows, 10)


def test_words_that_a_polynomial_cannot_tell_apart():
    from larkspur.llm.common import WordHasher

    one, other = "a", "b"
    for _ in range(12):  # Thue-Morse words: equal under any polynomial modulo 2**64
        one, other = one + other, other + one
    for seed in (20, 21):
        hashes = WordHasher(seed).words(f"{one} {other} short shorter {one}".encode())[2]
        assert len(set(hashes.tolist())) == 4 and hashes[0] == hashes[4]


@pytest.mark.parametrize("length,start,sizes", [(20, 10, [10, 20]), (20, 5, [5, 10, 20]), (20, 2, [2, 3, 5, 10, 20]), (7, 10, [4, 7]), (13, 3, [2, 4, 7, 13])])
def test_levels_lead_to_the_same_windows(spark, length, start, sizes):
    assert substrings.levels(length, start) == sizes
    rows = corpus(length + start)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substrings.remove_repeats(docs, length, start=start).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_windows(rows, length)
