"""Pipeline near-dedup against all pairs of shingle sets."""

import random

import pandas as pd
import pytest

from loomgrain.llm import neighbours, simhash
from loomgrain.llm.common import lower_ascii, utf8


def test_members_of_a_list_meet_behind_an_unrelated_head():
    cells = pd.DataFrame({"cell": 7, "node": [1, 2, 3], "size": 100, "place": [15, 5, 8], "block": 0, "whole": True, "component": [1, 2, 3]})
    assert neighbours.meetings(cells, 0.8).to_numpy().tolist() == [[2, 3]]  # the first has 85 shingles left, 89 must be shared
    cells["component"] = [1, 2, 2]
    assert not len(neighbours.meetings(cells, 0.8))


def plain_one_of_each(docs, words=5, similarity=0.8):
    """Ids kept: the least of each component of all pairs with that Jaccard similarity of word shingles."""
    sets = []
    for _, t in docs:
        w = lower_ascii(utf8(t or "")).split()
        sets.append({tuple(w[p : p + words]) for p in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a and b and len(a & b) >= similarity * len(a | b) - 1e-9) or (not a and docs[i][1] == docs[j][1]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted({docs[find(i)][0] for i in range(len(docs))})


def near_groups():
    """Documents of ascending id: copies with words replaced, at Jaccard about 0.6 to 0.95, alone and within shared boilerplate."""
    r, out = random.Random(3), []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    for share in (0, 0.3, 0.45):  # of each text is the same in all of its kind
        shared = [word() for _ in range(int(160 * share))]
        for _ in range(14):
            base = shared + [word() for _ in range(160 - len(shared))]
            out.append(" ".join(base))
            for edits in (1, 2, 3, 3, 4, 4, 5, 6, 8):
                text = list(base)
                for at in r.sample(range(len(shared), 160), edits):
                    text[at] = word()
                out.append(" ".join(text))
    stock = [word() for _ in range(160)]  # boilerplate alone with another end each: pairs at about 0.6
    out += [" ".join(stock[:120] + [word() for _ in range(40)]) for _ in range(90)]
    out += [" ".join(stock[:148] + [word() for _ in range(12)]) for _ in range(90)]
    return list(enumerate(out))


@pytest.mark.parametrize("block", [256, 8])
def test_one_of_each_is_all_pairs_jaccard(spark, block):
    docs = near_groups()
    kept = neighbours.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string"), block=block)
    assert sorted(r["doc_id"] for r in kept.collect()) == plain_one_of_each(docs)


@pytest.mark.parametrize("strangers", [0, 60, 240])
def test_recall_does_not_fall_as_strangers_share_more_lists(spark, strangers):
    """Pairs planted at Jaccard 0.80, 0.85 and 0.90 among texts that share passages with them: every pair is found, however many there are."""
    r = random.Random(strangers)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(7))
    docs, stock = [], [word() for _ in range(90)]
    for _ in range(12):
        base = stock[:40] + [word() for _ in range(164)]
        for edits in (4, 3, 2):  # apart from one another, each takes five of 200 shingles: 180 of 220, 185 of 215, 190 of 210
            text = list(base)
            for e in range(edits):
                text[60 + 20 * e] = word()
            docs.append(" ".join(text))
        docs.append(" ".join(base))
    docs += [" ".join(stock + [word() for _ in range(40)]) for _ in range(strangers)]
    docs = list(enumerate(docs))
    kept = neighbours.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string"), block=64)
    got = sorted(r["doc_id"] for r in kept.collect())
    assert got == plain_one_of_each(docs)
    assert got[:12] == [4 * i for i in range(12)]


def test_names_of_the_input_stay_its_own(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 70, 80, 90), (None, None, 1, 2, 3)], "doc_id long, text string, key int, _hash int, HASH int")
    assert sorted(tuple(x) for x in neighbours.keep_one_of_each(docs).where("doc_id is not null").collect()) == [(1, "a b c d e f", 7, 8, 9)]


def test_simhash_index_finds_what_shares_three_bytes(spark):
    """Every pair up to 5 bits apart and every other within the bits that shares three positional bytes, no pair else."""
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(300)]
    fps = {b ^ sum(1 << i for i in r.sample(range(64), n)) for b in base for n in (0, r.randint(1, 12))}
    signed = sorted(f - 2**64 if f >= 2**63 else f for f in fps)
    got = {(p["src"], p["dst"]) for p in simhash.near(spark.createDataFrame([(f, 0.5) for f in signed], "fp long, weight double"), 10).collect()}
    want, certain = set(), 0
    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            d = (a ^ b) & (2**64 - 1)
            if d.bit_count() <= 10 and d.to_bytes(8, "little").count(0) >= 3:
                want.add((a, b))
                certain += d.bit_count() <= 5
            assert d.bit_count() > 5 or (a, b) in got
    assert got == want and certain > 60


def test_members_of_a_long_simhash_list_meet_its_weightiest():
    lists = pd.DataFrame({"key": [3] * 5 + [4] * 3, "fp": [16, 1, 2, 4, 8, 32, 64, -1], "weight": [0, 0, 9, 0, 0, 0, 0, 0.0]})
    assert simhash.met(lists, 2, 4).to_numpy().tolist() == [[1, 2], [2, 4], [2, 8], [2, 16], [32, 64]]


def test_near_dedup_takes_its_pairs_by_simhash_and_loses_none_that_it_misses(spark, monkeypatch):
    docs = near_groups()
    table, found, real = spark.createDataFrame(docs, "doc_id long, text string"), [], simhash.near
    monkeypatch.setattr(simhash, "near", lambda *a: found.append(real(*a).collect()) or real(*a))
    kept = lambda: sorted(r["doc_id"] for r in neighbours.keep_one_of_each(table).collect())
    assert kept() == plain_one_of_each(docs)
    assert len(found) == 1 and len(found[0]) > 100
    monkeypatch.setattr(simhash, "near", lambda *a: real(*a).limit(0))
    assert kept() == plain_one_of_each(docs)
