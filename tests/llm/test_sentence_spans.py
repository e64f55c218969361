import random

import numpy as np
import pytest

from tessera.llm import sentence_spans as ss


def brute_runs(counts, k, w):
    ok = lambda i, j: j - i >= k and sum(counts[i:j]) >= w
    n = len(counts)
    forward = {(i, min((j for j in range(i, n + 1) if ok(i, j)), default=0)) for i in range(n)}
    backward = {(max((i for i in range(j) if ok(i, j)), default=-1), j) for j in range(1, n + 1)}
    return sorted((i, j) for i, j in forward | backward if 0 <= i < j)


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        counts = [rng.randrange(6) for _ in range(rng.randrange(12))]
        assert ss.runs(np.array(counts, np.int64), 2, 7) == brute_runs(counts, 2, 7)


def brute(rows, k, w):
    """``rows`` of (id, text): texts with later repeats removed."""
    seen, out = {}, []
    order = lambda r: (r[0] is None, r[0] or 0)
    parts = {r: ss.sentences(r[1] or "") for r in rows}
    plain = {r: [" ".join(p.lower().split()) for p in parts[r]] for r in rows}
    runs = {r: brute_runs([len(p.split()) for p in plain[r]], k, w) for r in rows}
    for r in sorted(set(rows), key=order):
        for i, j in runs[r]:
            key = tuple(" ".join(plain[r][i:j]).split())
            seen[key] = min(seen.get(key, (True, 0, 10**9)), (*order(r), i))
    for r in rows:
        gone = {p for i, j in runs[r] if seen[tuple(" ".join(plain[r][i:j]).split())] != (*order(r), i) for p in range(i, j)}
        out.append((r[0], None if r[1] is None else "".join(p for n, p in enumerate(parts[r]) if n not in gone), len(parts[r]), len(gone)))
    return out


@pytest.mark.parametrize("gather", [50, 10**7])
def test_equals_brute_force(spark, monkeypatch, gather):
    monkeypatch.setattr(ss, "GATHER_CHARS", gather)
    rng = random.Random(2)
    pool = [f"{' '.join(rng.choice('abcde') for _ in range(rng.randrange(1, 6)))}{rng.choice(['. ', '!', chr(10), '?! '])}" for _ in range(25)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(14)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, " \n"), (63, "no end"), (None, rows[5][1])] + rows[10:12]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["text"], r["n_sentences"], r["n_removed"]) for r in ss.remove_repeats(df, 2, 6).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 2, 6), key=repr)


def test_passages_go_but_for_the_first(spark):
    rng = random.Random(3)
    passage = " ".join(f"P{i}" + "." * (i % 9 == 8) for i in range(60)) + "."
    rows = [(i, f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(30))} {passage} And on it goes with {i}.") for i in range(300)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_removed int, spans string")
    out = ss.dedup(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[0] == rows[0][1]
    for i, text in rows[1:]:
        # the passage's first sentence is joined to what stands before it
        assert "P20" not in got[i] and "P59" not in got[i] and got[i].endswith(f"And on it goes with {i}.")


def test_odd_rows(odd, none):
    out = ss.remove_repeats(odd)
    assert out.count() == odd.count()
    assert sorted(map(repr, out.select(*odd.columns).collect())) == sorted(map(repr, odd.collect()))
    assert ss.dedup(odd).count() == odd.count()
    assert ss.remove_repeats(none).count() == ss.dedup(none).count() == 0


def words(rng, n):
    return [f"u{rng.randrange(10**6)}" for _ in range(n)]


def left_of(df, passage, **how):
    return {r["doc_id"]: sum(w in r["text"] for w in passage) for r in ss.dedup(df, **how).collect()}


def test_passages_go_inside_and_across_sentences(spark):
    rng = random.Random(5)
    one, two = words(rng, 50), words(rng, 50)
    rows = []
    for body in (" ".join(one), " ".join(two[:25]) + ". " + " ".join(two[25:])):
        for _ in range(40):
            around = [" ".join(words(rng, rng.randrange(1, 30))) for _ in range(2)]
            rows.append((len(rows), f"{around[0]} {body} {around[1]}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for passage, ids in ((one, range(40)), (two, range(40, 80))):
        got = left_of(df, passage)
        assert got[ids[0]] == 50 and max(got[i] for i in ids[1:]) <= 2 * (ss.WINDOW - 1)
        assert min(left_of(df, passage, window=None)[i] for i in ids) == 50  # whole sentences do not see them


def test_passages_without_blanks_or_ascii_marks_go(spark):
    rng = random.Random(6)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(n))
    passage = han(60)
    rows = [(i, f"{han(i % 12 + 3)}\u3002{passage}\u3002{han(9)}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = left_of(df, passage)
    assert got[0] == 60 and max(n for i, n in got.items() if i) <= 1
    assert all(r["text"].endswith(rows[r["doc_id"]][1][-9:]) for r in ss.dedup(df).collect())


def test_pieces_join_to_the_text_and_are_short():
    rng = random.Random(7)
    for _ in range(500):
        text = "".join(rng.choice(["a", "B", "\u4e16", " ", "\xa0", ".", "?! ", "\n", "\u3002", "\u00e9", "w "]) for _ in range(rng.randrange(80)))
        parts = ss.pieces(text, 4)
        assert "".join(parts) == text and all(len(ss._words(p)[0]) <= 4 for p in parts)
        found, hashes = ss.run_hashes(text, 2, 6, 4)
        assert len(found) == len(hashes) and all(0 <= i < j <= len(parts) for i, j in found)
