"""Cross-split overlaps against brute force."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest

from lattica.llm import overlap as O
from lattica.llm import queries
from lattica.session import work_dir

T0 = datetime(2024, 1, 1)
SCHEMA = "id bigint, task string, side int, label double, at timestamp_ntz, text string"


def found(spark, rows):
    pairs, members = O.near_copies(spark.createDataFrame(rows, SCHEMA))
    ids = {}
    for r in members.collect():
        ids.setdefault(r["class"], set()).add(r["id"])
    return {(a, b) for r in pairs.collect() for a in ids[r["class_a"]] for b in ids[r["class_b"]]}


WORDS = "tide harbour crate winch lamp store barrel ledger frame copper north grain pier south repair oiled bent loose checked patched mast rope".split()


def text(rng, n=22):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


def brute(rows):
    out = set()
    for i, task, side, label, at, t in rows:
        for j, task2, side2, label2, at2, t2 in rows:
            if side == 0 and side2 == 1 and task == task2 and None not in (t, t2, label, label2, task):
                near = abs(label - label2) <= max(0.01, 0.01 * max(abs(label), abs(label2))) + 1e-9
                timely = at is None and at2 is None or at is not None and at2 is not None and abs(at - at2) <= timedelta(days=3)
                a, b = O.normal(t), O.normal(t2)
                if near and timely and a and b and O.trigram_similarity(a, b) >= O.SIMILAR:
                    out.add((i, j))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows, texts = [], [text(rng) for _ in range(40)]
    for i in range(800):
        t = rng.choice(texts)
        if i % 2:
            words = t.split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            cut = rng.randrange(len(words)) if i % 4 == 1 else 0
            t = " ".join(words[cut:] + words[:cut])
        if i % 5 == 0:
            t = f"<td>{t.upper().replace(' ', '&nbsp;|  ')}</td>"
        at = rng.choice([None, T0 + timedelta(hours=rng.randrange(200))])
        rows.append((i, rng.choice("xy"), i // 2 % 2, rng.choice([1.0, 1.005, 2.0, 100.0, 100.9, -3.0]), at, t))
    want = brute(rows)
    got = found(spark, rows)
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)


def test_stated_cases(spark):
    t = "plot Vashnor-48 near Lommurgard; store: padded mirror; slope: 13.1 deg; yield: 552.50; observed: front seam bent, left post oiled, wide hatch cleaned, short rail tightened"
    moved = "slope: 13.1 deg; store: padded mirror; plot Vashnor-48 near Lommurgard; yield: 552,50; observed: front seam bent, left post oiled, wide hatch cleaned, short rail tightened"
    rows = [
        (1, "x", 0, 5.0, T0, t), (2, "x", 1, 5.0, T0, t.upper()), (3, "x", 1, 5.04, T0 + timedelta(days=3), moved), (4, "x", 1, 5.2, T0, t),
        (5, "x", 1, 5.0, T0 + timedelta(days=3, seconds=1), t), (6, "y", 1, 5.0, T0, t), (7, "x", 1, None, T0, t), (8, "x", 1, float("nan"), T0, t),
        (9, "x", 1, 5.0, None, t), (10, "x", 1, 5.0, T0, None), (11, "x", 1, 5.0, T0, " . "), (12, "x", None, 5.0, T0, t), (2, "x", 1, 5.0, T0, t.upper()),
        (13, "x", 1, 5.0, T0, t.replace("e", "é")), (14, "x", 1, 5.0, T0, ""), (15, None, 1, 5.0, T0, t),
    ]
    assert found(spark, rows) == {(1, 2), (1, 3), (1, 13)}


def test_fields_in_another_order(spark):
    """2,000 made-up records of 4 to 6 short fields against the same fields shuffled, all of which are alike."""
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(0, 4000, 2):
        fields = [f"{rng.choice(WORDS)}: {rng.choice(WORDS)} {rng.randrange(10_000)}" for _ in range(rng.randint(4, 6))]
        moved = rng.sample(fields, len(fields))
        joint = rng.choice(["; ", ", ", " | ", "\n", ";<br>"])
        rows += [(i, "x", 0, 1.0, None, "; ".join(fields)), (i + 1, "x", 1, 1.0, None, joint.join(moved))]
        want.add((i, i + 1))
    got = found(spark, rows)
    assert want <= got
    texts = {r[0]: O.normal(r[5]) for r in rows}
    assert all(O.trigram_similarity(texts[a], texts[b]) >= O.SIMILAR for a, b in got)


def test_moved_fields_and_typing_errors(spark):
    """Recall against brute force for records with fields moved and several letters changed."""
    rng = random.Random(18)
    rows, want = [], set()
    for i in range(0, 1200, 2):
        fields = [text(rng, 3) for _ in range(7)]
        a = "; ".join(fields)
        rng.shuffle(fields)
        b = list("; ".join(fields))
        for _ in range(rng.randint(2, 9)):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        b = "".join(b)
        rows += [(i, "x", 0, 1.0, None, a), (i + 1, "x", 1, 1.0, None, b)]
        if O.trigram_similarity(O.normal(a), O.normal(b)) >= O.SIMILAR:
            want.add((i, i + 1))
    got = found(spark, rows)
    assert len(want) > 300 and len(want - got) <= 0.01 * len(want)


def test_hashes_of_a_class_that_agree_by_half(spark):
    """Rows whose first hash agrees by chance are told apart by the second, by task, and by the texts."""
    t = "store: padded mirror; slope: 13.1 deg; yield: 552.50"
    rows = [(1, "x", 0, 1.0, None, t), (2, "y", 1, 1.0, None, t), (3, "x", 1, 1.0, None, "; ".join(t.split("; ")[::-1]))]
    pairs, members = O.near_copies(spark.createDataFrame(rows, SCHEMA))
    assert {len(r["class"]) for r in members.collect()} == {2} and pairs.count() == 1


def test_similar_texts_with_few_shared_chunks(spark):
    """Pairs just above the bound of shared chunks are all found."""
    rng = random.Random(8)
    rows, want = [], set()
    for i in range(0, 100_000, 2):
        fields = [text(rng, 2) for _ in range(6)]
        a = "; ".join(fields)
        rng.shuffle(fields)
        b = list("; ".join(fields))
        for _ in range(8):
            b[rng.randrange(len(b))] = rng.choice("xyz")
        b = "".join(b)
        x, y = O.normal(a), O.normal(b)
        if O.SHARED <= O.overlap_fractions([x], [y])[0] < O.SHARED + 0.1 and O.trigram_similarity(x, y) >= O.SIMILAR:
            rows += [(i, "x", 0, 1.0, None, a), (i + 1, "x", 1, 1.0, None, b)]
            want.add((i, i + 1))
        if len(want) == 20:
            break
    assert len(want) == 20 and found(spark, rows) == want


def test_trigram_bounds_are_no_less_than_the_similarity():
    rng = random.Random(9)
    texts = ["", "a", "ab", "abc"] + [O.normal("; ".join(text(rng, rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4)))) for _ in range(40)] + ["ab\nabc", "ab\ncd", "abcd\nx"]
    a, b = zip(*[(x, y) for x in texts for y in texts if x and y])
    plain = lambda x, y: 2 * (O.trigrams(x) & O.trigrams(y)).total() / (O.trigrams(x).total() + O.trigrams(y).total())
    assert all(bound >= plain(x, y) for bound, x, y in zip(O.trigram_bounds(list(a), list(b)), a, b))
    assert O._alike(list(a), list(b)) == [i for i, (x, y) in enumerate(zip(a, b)) if O.trigram_similarity(x, y) >= O.SIMILAR]


def test_copies_are_one_class(spark):
    rng = random.Random(4)
    t = text(rng)
    rows = [(i, "x", i % 2, 1.0, None, t) for i in range(300)] + [(1000 + i, "x", i % 2, 1.0, None, text(rng)) for i in range(100)]
    pairs, members = O.near_copies(spark.createDataFrame(rows, SCHEMA))
    assert pairs.count() == 1 and members.count() == 300


def test_large_buckets(spark, monkeypatch):
    """A bucket of one task, label and time that is laid out as a grid gives the pairs that it gives as a whole."""
    rng = random.Random(12)
    rows = [(i, "x", 0, 1.0, None, text(rng)) for i in range(300)]
    rows += [(1000 + i, "x", 1, 1.0, None, rows[i % 300][5].replace("a", "á" if i % 3 else "e", 1)) for i in range(400)]
    want = found(spark, rows)
    assert want == brute(rows) and len(want) >= 400
    monkeypatch.setattr(O, "BUCKET_ROWS", 50)
    monkeypatch.setattr(O, "CELL_CLASSES", (40, 60))
    assert found(spark, rows) == want


def test_candidates_are_not_written(spark):
    """Texts that share words but aren't alike make 100 times more candidates than rows."""
    rng = random.Random(13)
    rows = [(i, "x", i % 2, 1.0, None, text(rng)) for i in range(2000)]
    written = lambda: sum(p.stat().st_size for p in Path(work_dir(spark).removeprefix("file://")).rglob("*.parquet"))
    before = written()
    assert found(spark, rows) == set()
    assert written() - before < 100_000


def test_trigram_bits_leave_out_no_pair():
    rng = random.Random(10)
    texts = [O.normal("; ".join(text(rng, rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4)))) for _ in range(40)]
    texts += [t[k:] for t in texts for k in (1, 4)] + ["a", "ab", "abc", "ab\nabc", "ab\ncd", "abcd\nx"]
    bits, n = O.trigram_bits(texts)
    assert n.tolist() == [O.trigrams(t).total() for t in texts]
    a, b = np.divmod(np.arange(len(texts) ** 2), len(texts))
    possible = O._may_be_alike(bits, n, a, b)
    dice = lambda x, y: 2 * (x & y).total() / (x.total() + y.total())
    alike = np.array([dice(O.trigrams(texts[i]), O.trigrams(texts[j])) >= O.SIMILAR for i, j in zip(a, b)])
    assert alike.sum() > 2 * len(texts) and possible[alike].all() and possible.sum() < 2 * alike.sum()


def test_nothing(spark):
    assert found(spark, [(1, "x", 0, 1.0, None, None)]) == set()


def test_long_texts(spark):
    rng = random.Random(6)
    t = text(rng, 20_000)
    assert found(spark, [(1, "x", 0, 1.0, None, t), (2, "x", 1, 1.0, None, t + " end"), (3, "x", 1, 1.0, None, text(rng, 20_000))]) == {(1, 2)}


def test_chunks_follow_the_content():
    rng = random.Random(7)
    t = O.normal(text(rng, 60))
    row, digest, length = O.chunks([t, "", t[10:], t])
    assert length[row == 0].sum() == len(t) and not (row == 1).any() and digest[row == 0].tolist() == digest[row == 3].tolist()
    assert len(set(digest[row == 0]) & set(digest[row == 2])) >= 0.8 * (row == 2).sum()
    assert len(np.unique(digest[row == 0])) > 0.9 * (row == 0).sum()
    assert O.overlap_fractions([t], [t])[0] == pytest.approx(1)


def test_digests_are_of_whole_chunks():
    a, b = "x" * 40 + "a", "x" * 40 + "b"
    assert O.chunks([a])[1].tolist() != O.chunks([b])[1].tolist()


def test_queries(spark, small):
    pairs = [tuple(r) for r in queries.p3_found(spark, small).collect()]
    assert pairs and all(a < b for a, b in pairs) and len(pairs) == len(set(pairs))
    report = queries.p3_report(spark, small).collect()
    assert sum(r["n_pairs"] for r in report) == len(pairs) and all(r["n_overlapping"] <= r["n_rows"] for r in report)
