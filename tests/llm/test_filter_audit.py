import re
from itertools import permutations

import pytest

from tessera.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def fails(row, rows):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": row[0] is not None and any(o[0] is not None and o[0] < row[0] and (o[1] or "") == text for o in rows)}


def brute(rows, labels):
    """Every document through every order, filter by filter."""
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r, fails(r, rows)) for r in rows if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            alive = list(range(len(mine)))
            for k, f in enumerate(order):
                here = [i for i in alive if mine[i][1][f]]
                said = lambda i, c: any(x[0] is not None and x[0] == mine[i][0][0] and x[c] == 1 for x in labels)
                out[part, order, k + 1] = [
                    len(alive) - len(here), len(here),
                    sum(mine[i][1][f] for i in range(len(mine)) if i not in alive),
                    sum([g for g in "ABCDE" if m[1][g]] == [f] for m in mine),
                    sum(said(i, 1) for i in here), sum(said(i, 2) for i in here)]
                total[f] += len(here)
                alive = [i for i in alive if i not in here]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def got(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (5, 1, None), (6, 1, 1), (7, 1, 1), (None, 1, 1),
                                  (99, 1, 1)], LABELS)


def test_equals_every_document_through_every_order(spark, odd, labels):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    df = filter_audit.audit(odd.withColumnRenamed("source", "quality"), labels)
    assert got(df) == brute(rows, [tuple(r) for r in labels.collect()])
    assert df.count() == 600 * len({r[2] or "" for r in rows})


def test_copies_across_parts_and_repeated_rows(spark, labels):
    text = " ".join(f"w{i}" for i in range(250))
    rows = ([(i, text, "en" if i % 3 else "fr") for i in (5, 1, 6, 7, 1)] + [(None, text, "en")] * 4
            + [(1, text, "de"), (8, text + " $", "en"), (9, text.upper(), "en"), (10, "a " * 300, "fr"), (11, "", "")])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    result = got(filter_audit.audit(docs, labels))
    assert result == brute(rows, [tuple(r) for r in labels.collect()])
    # E first: the rows of the smallest id and those without one stay
    assert result["en", "EABCD", 1][1] == 2 and result["de", "EABCD", 1][1] == 0


def test_empty_tables(spark, none, odd, labels):
    assert filter_audit.audit(none, labels).count() == 0
    assert got(filter_audit.audit(odd, labels.limit(0)))["en", "ABCDE", 1][4:6] == [0, 0]


def test_exchanges_carry_no_text(spark, odd, labels):
    plan = filter_audit.cells(odd, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "CartesianProduct" not in plan and "Python" not in plan
