"""Operators with one right answer, against brute force."""

import hashlib
import itertools
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from loomgrain.llm import kneser_ney, minhash, neighbours, order, packing, queries, simhash, suffixes, unigram, vafile
from loomgrain.llm.common import utf8

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


# SentencePiece


def test_unigram_gives_the_best_path_of_the_public_library():
    proto = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    vocabulary = unigram.Vocabulary.load(MODEL)
    low = vocabulary.score < -1e8  # placeholders so low that single precision loses all else
    vocabulary.score[low] = -50_000
    for i in np.nonzero(low)[0]:
        proto.pieces[int(i)].score = -50_000
    theirs, ours = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), unigram.Unigram(vocabulary)
    texts = ["the quick brown fox", "Ünïcödé and naïve", "hestou theation lere", "x" * 100, "", " ", "日本語", "two  blanks", "a\nb"]
    ids, ends, _ = ours.encode(texts)
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == theirs.encode(t), t
        assert ours.decode(ids[ends[i] : ends[i + 1]]) == theirs.decode(theirs.encode(t))


def test_unigram_best_score_by_exhaustion():
    v = unigram.Vocabulary([b"<unk>", *[bytes([b]) for b in range(256)], b"a", b"b", b"ab", b"ba", b"aba", b" a", b" "], np.array([0.0] + [0.0] * 256 + [-3, -3, -4, -5, -6.5, -2, -4]), np.array([2] + [6] * 256 + [1] * 7, np.int32))
    coder = unigram.Unigram(v)
    for word in ("aba", "abab", "baab", "abca", "ba ab"):
        raw, pieces = " " + word, {s.decode(): c for s, c, k in zip(v.surface, v.score, v.kind) if k == 1}
        best = [-math.inf] * (len(raw) + 1)
        best[0] = 0
        for i, j in itertools.combinations(range(len(raw) + 1), 2):
            score = pieces.get(raw[i:j], coder.unknown if j == i + 1 else -math.inf)
            best[j] = max(best[j], best[i] + score)
        ids, _, score = coder.encode([word])
        assert score[0] == pytest.approx(best[-1])
        assert coder.decode(ids) == word


def test_long_units_take_the_same_path():
    coder = unigram.Unigram(unigram.Vocabulary.load(MODEL))
    text = "intheandering" * 4
    wide, coder.WIDE = coder.encode([text])[0].tolist(), 3
    assert coder.encode([text])[0].tolist() == wide


def test_a_long_text_without_blanks(spark):
    coder = unigram.Unigram(unigram.Vocabulary.load(MODEL))
    r = np.random.default_rng(3)
    text = "".join(r.choice(["the", "in", "日本", "x9", "é", "ering"], 40_000))
    ids, ends, score = coder.encode([text, "short one"])
    assert coder.decode(ids[ends[0] : ends[1]]) == text and np.isfinite(score).all()
    got = unigram.encode_documents(spark.createDataFrame([(1, text), (1, text), (None, " ".join([text, "b"] * 2))], "doc_id long, text string"), MODEL).collect()
    assert len(got) == 3 and all(x["round_trip"] for x in got)


def test_encode_documents_round_trip(messy, nothing):
    got = unigram.encode_documents(messy, MODEL).collect()
    assert len(got) == messy.count()
    assert all(r["round_trip"] for r in got if r["doc_id"] != 8)
    assert all(r["n_ids"] == len(r["ids"]) for r in got)
    assert unigram.encode_documents(nothing, MODEL).count() == 0


# fingerprints


def jaccard(a, b, k=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_fingerprints_follow_id_order_and_likeness(messy, nothing):
    got = minhash.fingerprint_documents(messy.where("doc_id <> 6 and doc_id is not null")).collect()
    docs = sorted((i, t or "") for i, t in rows(messy) if i is not None and i != 6)
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs)
    for (i, t), (_, n) in zip(docs, docs[1:] + docs[:1]):
        changed = minhash.edited(t, n)
        q = len(t) // 4
        assert changed == t[: len(t) - q] + n[: min(q, len(n))]
        r = by_id[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(utf8(changed)).hexdigest()
        assert r["near_edited"] == pytest.approx(jaccard(t, changed), abs=0.12)
        assert r["near_next"] == pytest.approx(jaccard(t, n), abs=0.12)
    assert by_id[0]["fingerprint"] == by_id[1]["fingerprint"] and by_id[3]["fingerprint"] == by_id[4]["fingerprint"]
    assert minhash.fingerprint_documents(nothing).count() == 0


def plain_successors(docs):
    """(id, length, edited text's digest) of every row in id order: null first, then by a hash of the text; after the last the first."""
    docs = sorted(docs, key=lambda d: (-(2**63) if d[0] is None else d[0], xxhash.xxh64_intdigest(utf8(d[1]), 42) + 2**63 & (2**64 - 1), d[1]))
    return Counter((i, len(t), hashlib.sha256(utf8(minhash.edited(t, n[1]))).hexdigest()) for (i, t), n in zip(docs, docs[1:] + docs[:1]))


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_fingerprints_of_repeated_and_null_ids(spark, messy, parts):
    crowd = [(None, None)] * 40 + [(77, "the same text again")] * 50 + [(78, f"text number {i} of one id") for i in range(60)]
    docs = messy.select("doc_id", "text").union(spark.createDataFrame(crowd, "doc_id long, text string")).repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = minhash.fingerprint_documents(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == plain_successors([(i, t or "") for i, t in rows(docs)])
    one = minhash.fingerprint_documents(messy.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_an_id_that_fills_several_blocks_is_split():
    blocks = order.Blocks([5, 7, 7, 7, 7, 9])
    h = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 4000)
    got = blocks.of(np.full(4000, 7), np.sort(h))
    assert (np.diff(got) >= 0).all() and np.bincount(got, minlength=6)[1:5].min() > 800 and blocks.of(np.array([8, 9, 3]), h[:3]).tolist() == [4, 5, 0]


# exact search


def by_sql(df):
    """The registered SQL over ``df``."""
    embeddings = df.select("vec_id", "embedding").toPandas()
    with duckdb.connect() as con:
        con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
        con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(None if i is None or i != i else int(i), None if v is None else [None if x is None else float(x) for x in v]) for i, v in zip(embeddings["vec_id"], embeddings["embedding"])])
        return sorted(con.execute(queries.ORACLE_SQL["op3_exact_top_k"]).fetchall())


def found_by(df, **options):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vafile.top_k(df, F.col("vec_id") % 20 == 0, k=20, **options).collect())


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 340)]
    bad = [(900, None), (901, [float("nan")] * 8), (902, [None] + [1.0] * 7), (None, [1.0] * 8), (903, [float("inf")] * 8), (904, [])]
    df = spark.createDataFrame(vectors + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("v", F.lit(2)).withColumn("asks", F.lit(False))
    got = {}
    for r in vafile.top_k(df, F.col("vec_id") % 20 == 0, k=20, block=64, query_block=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in vectors}
    for q in range(0, 340, 20):
        want = sorted(((-int(ints[q] @ x), i) for i, x in ints.items() if i != q))[:20]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert len(got) == 17
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>")
    assert vafile.top_k(few, F.col("vec_id") == 0).count() == 2
    assert vafile.top_k(few, F.col("vec_id") == 77).count() == 0
    assert vafile.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0


def test_top_k_keeps_repeated_rows_and_uneven_vectors_as_its_sql_does(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in rng.integers(-2, 3, size=6) / 8]) for i in rng.integers(0, 90, size=160)]  # ids and vectors repeat, scores tie
    vectors += vectors[:40] + [(20, [0.25] * 6)] * 30 + [(7, [0.25] * 6)] * 25 + [(40, [0.0] * 6), (61, [1.0]), (62, [9.0] * 9), (60, [0.5, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    assert found_by(df, block=16, query_block=4) == by_sql(df)
    three = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    assert found_by(three) == by_sql(three) == [(0, 1, 1, 4096), (0, 2, 1, 4096), (0, 3, 2, 4096)]


def test_top_k_reads_ties_in_rounds(spark):
    """A query of zeros ties with every row; the room for bounds is far smaller than that."""
    ids, q = np.array([3]), np.zeros((1, 4))
    v = np.arange(4000.0).reshape(-1, 4)
    files = {"exact-0": v, "ends-0": np.arange(1, 1001), "ids-0": np.arange(2000, 1000, -1), "exact-1": v, "ends-1": np.arange(1, 1001), "ids-1": np.arange(1000)}
    cells = vafile.Cells(v.min(axis=0), v.max(axis=0))
    search = vafile.Search(files, cells, ids, q, 5, room=100)
    for b in (0, 1):
        search.scan(b, cells.codes(v).astype(float), files[f"ids-{b}"], files[f"ids-{b}"])
    search.settle()
    assert search.found[0] == [(0.0, 0), (0.0, 1), (0.0, 2), (0.0, 4), (0.0, 5)]


@pytest.mark.parametrize("size", [1e3, 1e9, 1e200])
def test_top_k_of_large_components(spark, size):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=5) * size]) for i in range(60)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors}
    want = []
    for q in (0, 20, 40):
        best = sorted((-sum(a * b for a, b in zip(ints[q], x)), i) for i, x in ints.items() if i != q)[:20]
        want += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    got = found_by(df, block=16, query_block=2)
    if size < 1e100:
        assert got == want
    else:  # scores past 64 bits are all the ends of the range
        assert [(g[0], g[3]) for g in got] == [(w[0], w[3]) for w in want]


# packing


def test_packing_keeps_every_token_in_place(spark, messy, nothing):
    marks = ["hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  ", " <|endoftext|>\n", "<|endoftext", "日本語 <|endoftext|> テ", "a\x00b"]
    messy = messy.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(marks, 100)), "doc_id long, text string"))
    got = packing.pack(messy).collect()
    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = Counter()
    for i, t in rows(messy):
        ids = np.array([*hf.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at, to, n = 0, len(ids) % 1024 or 1024, 0
        while at < len(ids):
            pieces[i, n, at, to - at, zlib.crc32(ids[at:to].tobytes())] += 1
            at, to, n = to, to + 1024, n + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(nothing).count() == 0


def test_ids_of_whole_tables_are_the_tokenizer_library_s(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    hf, ours = Tokenizer.from_file(path), packing.encoder(path)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for text, theirs in zip(texts, hf.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text, allowed_special="all") == theirs.ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_histogram_tightly(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5.5, 0.8, 6000).astype(int), 1, 1024)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan_sequences(histogram, 1024)
    held = Counter()
    for pattern, n in plan:
        assert sum(pattern) <= 1024
        for length in pattern:
            held[length] += n
    assert held == Counter(histogram)
    assert sum(n for _, n in plan) <= 1.01 * math.ceil(lengths.sum() / 1024) + 1


# language model


def test_kneser_ney_against_plain_counts(spark):
    docs = {i: t for i, t in enumerate(["a b a b c", "b c a A", "", "a b d d d d", "c c a b e f g", None, "b a b a", "x y z", "a b c x q"])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("score", F.lit(0))
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    held_two = kneser_ney.score_documents(df)
    tokens = {i: [*(t or "").lower().split(), "</s>"] for i, t in docs.items()}
    train = [tokens[i] for i in docs if not held[i]]
    uni, bi = Counter(), Counter()
    for t in train:
        uni.update(t)
        bi.update(zip(["<s>", *t], t))
    n, v = sum(uni.values()), len(uni)

    def discounts(counts):
        k = Counter(counts)
        if not all(k[i] for i in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = k[1] / (k[1] + 2 * k[2])
        return [0, *[min(max(j - (j + 1) * y * k[j + 1] / k[j], 0.01), j) for j in (1, 2, 3)]]

    a = Counter(w for _, w in bi)
    d2, d1 = discounts(bi.values()), discounts(a.values())
    cut = lambda c, d: max(c - d[min(c, 3)], 0)
    rest = sum(d1[min(c, 3)] for c in a.values()) / len(bi)
    p1 = lambda w: cut(a[w], d1) / len(bi) + rest / (v + 1)

    def p2(u, w):
        total = sum(c for (x, _), c in bi.items() if x == u)
        if not total:
            return p1(w)
        gap = sum(d2[min(c, 3)] for (x, _), c in bi.items() if x == u) / total
        return cut(bi[u, w], d2) / total + gap * p1(w)

    words = [*uni, "unseen"]
    assert sum(p2("a", w) for w in words) == pytest.approx(1)
    for r in held_two.collect():
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(t), n)
        assert r["n_known"] == sum(uni[w] > 0 for w in t)
        assert r["base_score"] == pytest.approx(sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert r["score"] == pytest.approx(sum(math.log10(p2(u, w)) for u, w in zip(["<s>", *t], t)))


def test_kneser_ney_edges(messy, nothing, spark):
    got = kneser_ney.score_documents(messy).collect()
    assert len(got) == messy.count() and all(math.isfinite(r["score"]) for r in got)
    assert kneser_ney.score_documents(nothing).count() == 0
    many = spark.createDataFrame([(i, "a b c") for i in range(600)], "doc_id long, text string")
    model = kneser_ney.train(many)
    assert kneser_ney.Scorer(model).score(["a b c"])["score"][0] > -0.1  # counts beyond a byte
    model.delete()


# near-duplicates


def plain_simhash(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split() if text else []
    w = [x for x in w if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_a_missing_array_is_an_error(spark, messy):
    model = kneser_ney.train(messy.select("doc_id", "text"), shards=3)
    files = sorted(f"{model.folder}/{f}" for f in os.listdir(model.folder) if "key" in f)
    assert len(files) == 6
    kneser_ney.Scorer(model).score(["that then"])
    for f in files:
        os.remove(f)
    with pytest.raises(FileNotFoundError):
        kneser_ney.Scorer(model).score(["that then"])


def test_frequent_words_are_those_of_all_rows(spark):
    docs = spark.createDataFrame([(i, f"common w{i} x{i} y{i}" if i < 900 else "late " * 40) for i in range(1000)], "doc_id long, text string").coalesce(1)
    h = {w: int(kneser_ney.tokens_of([w])[0][0]) for w in ("common", "late", "w3")}
    got = set(kneser_ney.frequent_words(docs, share=0.05).tolist())
    assert h["common"] in got and h["late"] in got and h["w3"] not in got


def test_simhash_components(messy, nothing):
    got = simhash.near_duplicates(messy).collect()
    docs = rows(messy)
    assert len(got) == len(docs)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{plain_simhash(t):016x}") for i, t in docs)
    check_components({(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in got})
    assert simhash.near_duplicates(nothing).count() == 0


def check_components(found):
    nodes = list(found)
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for x, y in itertools.combinations(nodes, 2):
        if (x[1] ^ y[1]).bit_count() <= 2:
            root[top(x)] = top(y)
    for n in nodes:
        ids = [m[0] for m in nodes if top(m) == top(n) and m[0] is not None]
        assert found[n] == (min(ids) if ids else None)


@pytest.mark.parametrize("crowded", [0, 3, 64])
def test_links_lose_nothing(spark, crowded):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 12)
    values = {int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 64, (20, 2))}
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), crowded=crowded).collect()
    assert all(((e[0] ^ e[1]) & (2**64 - 1)).bit_count() <= 2 for e in edges)
    root = {v: v for v in signed}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[top(a)] = top(b)
    ours = Counter(top(v) for v in signed)
    root = {v: v for v in signed}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            root[top(a)] = top(b)
    assert sorted(ours.values()) == sorted(Counter(top(v) for v in signed).values())


def test_shared_lists_tell_shared_bytes():
    assert len(simhash.LISTS) == 14 and simhash.least_matches(2) == 3
    for k in range(9):
        for kept in itertools.combinations(range(8), k):
            shared = sum(set(p) <= set(kept) for p in simhash.LISTS)
            assert shared == {8: 14, 7: 7, 6: 3}[k] if k >= 6 else shared <= 1


def test_one_of_each_near_copy_stays(messy, nothing):
    kept = neighbours.keep_one_of_each(messy)
    assert kept.columns == messy.columns
    got = Counter(i for i, _ in rows(kept))
    assert got[0] == 1 and got[1] == got[2] == 0  # a copy, and a near copy
    assert got[3] == 1 and got[4] == 0 and got[6] == 2 and got[9] == got[10] == got[7] == got[8] == 1
    assert neighbours.keep_one_of_each(nothing).count() == 0


# repeated windows


def plain_removal(docs, window):
    seen, out = {}, []
    order = sorted(((math.inf if i is None else i, i, utf8(t or "")) for i, t in docs), key=lambda d: d[0])
    starts = [[(b[p : p + window]) for p in range(len(b) - window + 1)] for _, _, b in order]
    for (k, _, _), s in zip(order, starts):
        for x in s:
            seen[x] = min(seen.get(x, k), k)
    for (k, i, b), s in zip(order, starts):
        gone = bytearray(len(b))
        for p, x in enumerate(s):
            if seen[x] < k:
                gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("crowd", [0, 2000])
def test_removals_equal_brute_force(messy, nothing, crowd, monkeypatch):
    monkeypatch.setattr(suffixes.spans_of, "__defaults__", (crowd,))
    long = messy.where("doc_id = 9").withColumns({"doc_id": F.lit(20).cast("long"), "text": F.concat(F.substring("text", 60_001, 200), F.lit("~"), F.substring("text", 1, 90_000))})
    docs = messy.union(long)
    assert Counter(tuple(r) for r in suffixes.removals(docs).collect()) == plain_removal(rows(docs), 50)
    assert suffixes.removals(nothing).count() == 0


def test_radix_order_sorts_bytes_and_tells_what_neighbours_share():
    rng = np.random.default_rng(8)
    suffix = rng.integers(0, 2, (400, 21)).astype(np.uint8)
    suffix[:, :9] = suffix[rng.integers(0, 6, 400), :9]
    group = rng.integers(0, 3, 400)
    order, shared = suffixes.radix_order(suffix, group)
    keyed = [(group[i], suffix[i].tobytes()) for i in order]
    assert keyed == sorted(keyed)
    for (g, a), (h, b), n in zip(keyed, keyed[1:], shared[1:]):
        assert n == (-1 if g != h else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 21))


def test_copies_of_one_text_are_dealt_over_all_shards():
    place = suffixes._place_of(np.arange(4000), np.full(4000, 77), 16)
    assert np.bincount(place, minlength=16).max() < 400


def test_deduplicate_keeps_columns_and_whole_characters(spark, messy):
    got = suffixes.deduplicate(messy)
    assert got.columns == messy.columns and got.count() == messy.count()
    text = "é" * 60
    df = spark.createDataFrame([(1, text + "abc"), (2, "x" + text), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in suffixes.deduplicate(df).collect()} == {1: text + "abc", 2: "x", 3: None}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(columns).collect())) == Counter(cur.fetchall())
