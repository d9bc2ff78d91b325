import hashlib
import random
import zlib

import numpy as np
import pytest

from larkspur.llm import embeddings, media, mixing, packing
from larkspur.llm.queries import tokenizer_path


def test_lattice_points_are_nearest():
    assert len(embeddings.STEPS) == 240 and (np.square(embeddings.STEPS).sum(1) == 8).all()
    points = np.random.default_rng(1).normal(size=(200, 8)) * 2
    at = embeddings.decode(points)
    parity = at % 2
    assert ((parity == 0).all(1) | (parity == 1).all(1)).all() and (at.sum(1) % 4 == 0).all()
    best = np.square(2 * points - at).sum(1)
    for step in embeddings.STEPS:
        assert (best <= np.square(2 * points - at - step).sum(1) + 1e-9).all()


@pytest.mark.parametrize("block", [2048, 3])
def test_vectors_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + rng.normal(size=16) * 0.1).tolist(), 1) for i in range(60)]
    rows += [(200 + i, base[0].tolist(), 2) for i in range(6)] + [(300, (base[1] * 7).tolist(), 3)]
    odd = [(400, None, 4), (401, [0.0] * 16, 4), (402, [float("nan")] * 16, 4), (403, [1.0, None], 4), (404, [], 4), (None, base[2].tolist(), 4), (405, [float("inf")] * 16, 4), (406, [1.0] * 3, 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    link = {i: [j for j in unit if j != i and unit[i] @ unit[j] >= 0.9] for i in unit}
    root = {i: i for i in unit}
    for _ in unit:
        root = {i: min([root[i], *(root[j] for j in link[i])]) for i in unit}
    assert {i: got[i] for i in unit} == {i: (len(link[i]), root[i], root[i] == i) for i in unit}
    assert all(got[i] == (0, i, True) for i in (400, 401, 402, 403, 404, 405, 406)) and got[None][0] == 0
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_codec_tables():
    # Fixed values of G.711: silence and both ends.
    assert [int(media.ULAW_TABLE[c]) for c in (0x00, 0x7F, 0x80, 0xFF)] == [-32124, 0, 32124, 0]
    assert [int(media.ALAW_TABLE[c]) for c in (0x00, 0x55, 0x80, 0xD5, 0x2A)] == [-5504, -8, 5504, 8, -32256]


def plain_ima(block):
    sample = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), [sample]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = media.STEP_SIZES[index]
            diff = (step >> 3) + (step if nibble & 4 else 0) + (step >> 1 if nibble & 2 else 0) + (step >> 2 if nibble & 1 else 0)
            sample = max(-32768, min(32767, sample - diff if nibble & 8 else sample + diff))
            index = max(0, min(88, index + media.INDEX_STEPS[nibble & 7]))
            out.append(sample)
    return out


def test_adpcm_and_resampling():
    raw = np.random.default_rng(3).integers(0, 256, (20, 64), dtype=np.uint8)
    assert media.decode_ima(raw).tolist() == [plain_ima(b.tolist() and bytes(b)) for b in raw]
    assert media.resample(np.array([0, 10, -10], np.int16)).tolist() == [0, 5, 10, 0, -10, -10]


def test_media_round_trip(spark):
    texts = [None, "", "a", "a" * 64, "é" * 40, "x" * 300_000, "a"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    stored = media.store_payloads(docs)
    got = {r.doc_id: r for r in media.describe(stored).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data_padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(data_padded), hashlib.sha256(data_padded).hexdigest(), zlib.crc32(data_padded[-64:]))
    assert got[2].feature == got[6].feature and got[2].media_sha256 == got[6].media_sha256 and got[0].feature == got[1].feature
    pcm = {r.doc_id: bytes(r.pcm) for r in media.resampled(stored).collect()}
    assert len(pcm[3]) == 64 * 2 * 2 and pcm[3] == media.resample(media.ULAW_TABLE[np.frombuffer(b"a" * 64, np.uint8)]).tobytes()
    assert media.describe(media.store_payloads(docs.where("false"))).count() == 0
    assert media.to_pcm(media.wav(bytes(range(64)), media.IMA, bits=4, align=64)).tolist() == plain_ima(bytes(range(64)))
    with pytest.raises(ValueError):
        media.read_wav(b"nonsense")


def targets_by_rounds(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = {s: cap * sizes[s] for s in free if level * weight[s] >= cap * sizes[s]}
        if not over:
            return capped | {s: level * weight[s] for s in free}
        capped |= over


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["s", "t", "u", "é", "Z", None]), " ".join("w" * rng.randint(0, 30))) for i in range(900)]
    rows += [(2000 + i, "hot", "a b c") for i in range(800)] + [(5000, "empty", None), (5001, "empty", ""), (None, "s", "a b"), (7, "s", "a b c d")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, source string, text string, size int, target double")
    plan = mixing.mix_plan(docs).collect()
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = targets_by_rounds(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in plan:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= 0.15 * want[s] + 30 for s in sizes)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan) == mixing.mix(docs.repartition(5)).count()
    assert mixing.mix(docs.where("false")).count() == 0


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([1, 50, 700]))] + [capacity] * 3
    histogram = {n: lengths.count(n) for n in set(lengths)}
    held, ranks = {}, {}
    for length, rank, count, first, offset in packing.plan(histogram, capacity):
        ranks.setdefault(length, []).extend(range(rank, rank + count))
        for s in range(first, first + count):
            held.setdefault(s, []).append((offset, length))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
    for slots in held.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) == best_fit_decreasing(lengths, capacity)


def test_packing_matches_whole_text_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", " ", "it's  Don't ½ Ⅷ İstanbul", "naïve, co-op. 12a3 <|endoftext|>x", "ΑΣ ΣΑΣ. a\x0bb c\x1cd.", "a\x01b", "word " * 5000, "Zebra,\nzebra. ZEBRA", "Zebra,\nzebra. ZEBRA"]
    docs = spark.createDataFrame([(min(i, 8), t, 0) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    pieces = packing.pack(packing.stored(packing.tokenize(docs, tokenizer_path(), 128, keep_ids=True), "t"), 128, salts=3).collect()
    want = []
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(min(i, 8), k // 128, k, np.array(ids[k : k + 128], "<u4").tobytes()) for k in range(0, len(ids), 128)]
    assert sorted((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in pieces) == sorted(want)
    assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.length == len(r.ids) // 4 for r in pieces)
    held = {}
    for r in pieces:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] for s in held.values())
    assert len(held) == best_fit_decreasing([r.length for r in pieces], 128)
    assert packing.pack_documents(docs.where("false"), tokenizer_path()).count() == 0


def plain_alaw(code):
    """A-law expansion by its definition, one code at a time."""
    code ^= 0x55
    size = (code & 15) << 4
    exponent = (code >> 4) & 7
    size = size + 8 if not exponent else (size + 0x108) << (exponent - 1)
    return size if code & 0x80 else -size


def plain_ulaw(code):
    code = ~code & 0xFF
    size = (((code & 15) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return -size if code & 0x80 else size


def test_stored_pcm_matches_brute_force(spark):
    assert [int(x) for x in media.ALAW_TABLE] == [plain_alaw(c) for c in range(256)] and [int(x) for x in media.ULAW_TABLE] == [plain_ulaw(c) for c in range(256)]
    texts = [None, "", "abc é " * 30, "".join(map(chr, range(1, 300))), "x" * 100_000, "abc é " * 30]
    docs = spark.createDataFrame([(i if i != 4 else None, t, b"1", 2) for i, t in enumerate(texts)], "doc_id long, text string, media binary, n_bytes int").repartition(2)
    stored = media.store_pcm(docs)
    files = {r.doc_id: bytes(r.media) for r in stored.collect()}
    got = {r.doc_id: r for r in media.describe(stored).collect()}
    for i, text in enumerate(texts):
        i = i if i != 4 else None
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        wide = [plain_alaw(b) for b in padded]
        pcm = [v for k, x in enumerate(wide) for v in (x, (x + wide[min(k + 1, len(wide) - 1)]) // 2)]
        kind, held = media.read_wav(files[i])
        assert kind == media.PCM and np.frombuffer(held, "<i2").tolist() == pcm and media.payload_of(files[i]) == padded
        loud = sum(abs(plain_ulaw(b)) for b in padded), sum(map(abs, wide)), sum(abs(v) for at in range(0, len(padded), 64) for v in plain_ima(padded[at : at + 64]))
        r = got[i]
        assert r.feature == f"u{loud[0]}-a{loud[1]}-i{loud[2]}-r{zlib.crc32(held):08x}"
        assert (r.n_bytes, r.payload_bytes, r.media_bytes, r.media_sha256) == (len(data), len(padded), len(files[i]), hashlib.sha256(files[i]).hexdigest())
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_ids_of_words_match_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tokenizer, encoder = Tokenizer.from_file(path), packing.encoder(path)
    assert isinstance(encoder, packing._Words) and isinstance(packing.encoder(tokenizer_path("byte_bpe_50k.json")), packing._Texts)
    rng = random.Random(7)
    letters = "abcdefghijkzàéßöñÿŸİıſKΣςабв中𝔸0129²½ⅧªºµÀÖ'’.,!#$%&*-_<>|@\x01\x00\x1c\x1f\x7f\x85\xa0\xaḏ̀​　﻿ \t\n\r\x0b\x0c"
    words = ["don't", "it's", "we'll", "I'M", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "''re", "a'd", "HELLO", "H̱", "naïve", "x" * 60]
    texts = ["".join(rng.choice(words) if rng.random() < 0.15 else rng.choice(letters) if rng.random() < 0.6 else rng.choice("etaoinshr ") for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.texts(texts) == want and [encoder.texts([t])[0] for t in texts[:300]] == want[:300] and encoder.texts([]) == []


def test_other_tokenizers_take_whole_texts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = ["Zebra,  zebra.\n\nZEBRA", "", None, " a  b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packing.tokenize(docs, path, keep_ids=True).collect()}
    assert got == {i: [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_no_setting_of_the_session_changes(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "unset")
    docs = spark.createDataFrame([(i, "a b c") for i in range(5)], "doc_id long, text string")
    packing.pack_documents(docs, tokenizer_path()).count()
    media.describe(media.store_pcm(docs)).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "unset") == before
