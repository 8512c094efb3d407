import math
import random
from collections import Counter

import numpy as np
import pytest

from nodeloom.llm import repetition as rep


def brute(ws, n=8):
    covered, seen = set(), set()
    for i in range(len(ws) - n + 1):
        run = tuple(ws[i : i + n])
        if run in seen:
            covered |= set(range(i, i + n))
        seen.add(run)
    return len(covered)


def test_repeated_words_equal_brute_force():
    r = random.Random(1)
    for _ in range(400):
        ws = [r.choice("abcdefgh"[: r.randrange(1, 9)]) for _ in range(r.randrange(0, 80))]
        if r.random() < 0.5:
            ws = ws + ws[r.randrange(len(ws) + 1) :] * r.randrange(3)
        for n in (2, 8):
            assert rep.repeated_words(ws, n) == brute(ws, n)


def test_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(rep, "_MULTIPLIER", 0)
    r = random.Random(2)
    ws = [r.choice("abc") for _ in range(60)] * 2
    h = rep.repeated_words(ws)
    assert h == brute(ws)


def test_words():
    assert rep.words("Don't STOP, v2 x_y 日本カナ한글 é") == ["don", "t", "stop", "v", "x", "y", "日", "本", "カ", "ナ", "한글", "é"]
    assert rep.words(" \n12 …") == []


def by_hand(texts, n=8):
    """(score, threshold) of each text, one feature at a time."""
    raw, target, lists = Counter(), Counter(), {}
    for k, text in texts.items():
        ws, seen, mine = rep.words(text or ""), Counter(), []
        for i in range(len(ws) - n + 1):
            at = int(rep.gram_hashes(np.array([rep._Numbers()[w] for w in ws[i : i + n]], np.uint64), n)[0]) % rep.BUCKETS
            run = tuple(ws[i : i + n])
            mine.append((at, seen[run] > 0))
            seen[run] += 1
        raw.update(mine)
        if not any(again for _, again in mine):
            target.update(mine)
        lists[k] = mine
    p, size = rep.PRIOR, 2 * rep.BUCKETS * rep.PRIOR
    total = math.log((raw.total() + size) / (target.total() + size))
    llr = {k: sum(math.log((target[f] + p) / (raw[f] + p)) + total for f in fs) / len(fs) if fs else None for k, fs in lists.items()}
    return llr, total - 0.4 / n * math.log((1 + p) / p)


RUN = "one two three four five six seven eight nine ten".split()


def novel(k, at=0):
    return [f"w{chr(97 + (at + i) // 676)}{chr(97 + (at + i) // 26 % 26)}{chr(97 + (at + i) % 26)}" for i in range(k)]


def test_flags_follow_the_share_and_scores_the_definition(spark):
    texts = {1: RUN * 2, 2: RUN + novel(5) + RUN, 3: RUN + novel(6) + RUN, 4: novel(40), 5: RUN * 5, 6: [], 8: RUN, 9: RUN + novel(4) + RUN}
    texts = {k: " ".join(t) for k, t in texts.items()} | {7: None}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, flagged string")
    got = {r.doc_id: r for r in rep.scored(docs).collect()}
    assert len(got) == 9 and got[2].share == 0.4 and got[7].share == got[6].share == 0.0
    assert {k for k, r in got.items() if r.flagged} == {1, 2, 5, 9}
    llr, limit = by_hand(texts)
    for k, r in got.items():
        assert r.threshold == pytest.approx(limit) and r.llr == (None if llr[k] is None else pytest.approx(llr[k]))
        assert not r.flagged or r.llr <= r.threshold
    assert got[4].llr > got[4].threshold  # settled by the score alone
    few = {r.doc_id: r for r in rep.scored(docs, every=False).collect()}
    assert {k for k, r in few.items() if r.flagged} == {1, 2, 5, 9} and few[4].n_repeated is None


def test_scattered_repeats_stay_below_the_threshold(spark):
    """The worst case of the bound: runs of exactly eight words, each repeated once, far apart."""
    texts = {}
    for k in range(1, 30):
        parts, far = [], 40 * k
        runs = [novel(8, 10_000 + far + 8 * i) for i in range(k)]
        for i, run in enumerate(runs):
            parts += run + novel(2, far * 3 + 2 * i)
        for i, run in enumerate(runs):
            parts += run + novel(2, 8_000 + far * 3 + 2 * i)
        texts[k] = " ".join(parts)
    texts |= {100 + i: " ".join(novel(60, 200 * i)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in rep.scored(docs, every=False).collect()}
    want = {k for k, t in texts.items() if brute(rep.words(t)) * 5 >= len(rep.words(t)) * 2}
    assert want == set(range(1, 30)) == {k for k, r in got.items() if r.flagged}
    assert all(got[k].llr <= got[k].threshold for k in want)


def test_flags_come_through_the_multinomials(spark):
    docs = spark.createDataFrame([(1, " ".join(RUN * 3))], "doc_id long, text string")
    counted = rep.count_features(docs)
    assert counted.raw.sum() == 23 and counted.raw[: rep.BUCKETS].sum() == 10 and counted.target.sum() == 0
    assert rep.scored(docs, counted=counted).first().flagged
    assert not rep.scored(docs, counted=rep.Multinomials(counted.raw, counted.raw)).first().flagged  # a target that is no better


def test_no_repeats_flags_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert not any(r.flagged for r in rep.scored(docs).collect()) and rep.scored(docs.limit(0)).collect() == []


def test_small_tables(spark, sf):
    from nodeloom.session import table

    docs = table(spark, sf, "documents")
    want = set()
    for d in docs.collect():
        ws = rep.words(d.text or "")
        if ws and brute(ws) * 5 >= len(ws) * 2 and brute(ws):
            want.add(d.doc_id)
    assert {r.doc_id for r in rep.scored(docs).where("flagged").collect()} == want
