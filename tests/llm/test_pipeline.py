"""The pipeline against plain Python: every stage is held against brute force on its own input."""
import hashlib
import os
import random
import sys
import tempfile
from collections import Counter

import tiktoken
from test_mixing import plain_targets
from test_sentence_spans import brute
from test_simhash import plain_components, plain_print

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tessera.llm.bpe_transducer import read_ranks  # noqa: E402
from tessera.llm.queries import PATTERN, ranks_path  # noqa: E402


def corpus():
    rng = random.Random(11)
    words = {"xa": [f"{a}{b}en" for a in "bdgkmnt" for b in "aeiou"], "xb": [f"{a}{b}os" for a in "flprsvz" for b in "aeiou"]}
    passage = " ".join(f"Passage{i}" + "." * (i % 8 == 7) for i in range(56))
    rows = []
    for i in range(140):
        lang = "xa" if i % 3 else "xb"
        text = " ".join(rng.choice(words[lang]) + ("." if rng.random() < 0.15 else "") for _ in range(rng.randrange(40, 160)))
        if i % 10 == 0:
            text = f"{text}. {passage} {rng.choice(words[lang])}"
        rows.append((i, text, lang, rng.choice(["hot"] * 5 + ["s1", "s2", None]), len(text)))
    for i in range(140, 170):
        old = rows[rng.randrange(60)]
        text = old[1] if i % 2 else old[1] + " x"
        rows.append((i, text, old[2], old[3], len(text)))
    return rows + [(170, None, "xa", "s1", None), (171, "", None, None, 0), (172, "12 34 .", "xb", "s2", 7), rows[3]]


def test_every_stage_equals_brute_force(spark):
    rows = corpus()
    d = tempfile.mkdtemp(prefix="tessera-pipe-")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(
        f"{d}/documents.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, inputs = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(sorted(map(tuple, docs.collect()), key=repr))
        stage(spark, docs, d).write.parquet(f"{d}/out-{k}")
        docs = spark.read.parquet(f"{d}/out-{k}")
        assert k == 4 or docs.columns == columns
    raw, named, single, cut, mixed = inputs

    assert len(raw) == len(rows)
    assert named == sorted((r for r in rows if r[0] not in (170, 171, 172)), key=repr)  # only those without letters go

    ordered = sorted(set(named))
    label = plain_components([plain_print(r[1]) for r in ordered], 4)
    assert single == sorted((r for k, r in enumerate(ordered) if label[k] == k), key=repr) and len(single) < len(set(named)) - 20

    left = {r[0]: r for r in brute([(r[0], r[1]) for r in single], 2, 20)}
    want = [(i, left[i][1], *rest) for i, _, *rest in single if left[i][3] == 0 or left[i][1].strip()]
    assert cut == sorted(want, key=repr)
    assert sum("Passage20" in r[1] for r in cut) == 1 < sum("Passage20" in r[1] for r in single)

    size = Counter()
    for r in cut:
        size[r[3]] += len(r[1].split())
    taken, times = Counter(), Counter(r[0] for r in mixed)
    for r in mixed:
        taken[r[3]] += len(r[1].split())
    assert set(mixed) <= set(cut) and max(times.values()) <= 3
    longest = max(len(r[1].split()) for r in cut)
    for source, target in plain_targets(size, (1, 2, 3), 3).items():
        assert abs(taken[source] - target) <= longest / 2 + 1

    with open(ranks_path(), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(f), special_tokens={})
    got = sorted((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in docs.collect())
    assert got == sorted((r[0], tuple(ids := library.encode_ordinary(r[1])), len(ids), hashlib.sha256(r[1].encode()).hexdigest())
                         for r in mixed)
    again = corpus_pipeline.run(spark, d)
    assert sorted((r["doc_id"], tuple(r["ids"]), r["n_tokens"], r["decoded_sha256"]) for r in again.collect()) == got


def test_an_empty_table_passes_through(spark):
    d = tempfile.mkdtemp(prefix="tessera-pipe-")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
