"""Source edge files (written to a scratch folder) and sink round trips."""
import os
import tempfile

import pytest

from tessera.operators import boundaries as bd
from tessera.operators import tokenizers as tk
from tessera.operators.split import exact_split, shuffled, split_summary
from tessera.plans.corpus import prepare_corpus
from tessera.sinks import io
from tessera.sources import corpus as src


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tessera-test-")


def write(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else data.encode())


def test_language_files(spark, scratch):
    write(f"{scratch}/raw/north side/a.txt", b"one\r\ntwo\rthree\n\nfour \xff\n")
    write(f"{scratch}/raw/north side/notes.md", "skip me\n")
    write(f"{scratch}/raw/north side/nested/b.txt", "nested\n")
    write(f"{scratch}/raw/a+b/c.txt", "\ufefflast line")
    write(f"{scratch}/raw/a+b/empty.txt", "")
    with pytest.warns(UserWarning, match="south"):
        df = src.read_language_files(spark, f"{scratch}/raw", ["north side", "a+b", "south"])
    rows = [tuple(r) for r in df.select("lang", "line_no", "line", "valid_utf8").orderBy("lang", "line_no").collect()]
    assert rows == [("a+b", 0, "\ufefflast line", True)] + [
        ("north side", i, x, False) for i, x in enumerate(["one", "two", "three", "", "four \ufffd"])]
    assert src.read_language_files(spark, f"{scratch}/raw", []).count() == 0


def test_large_file_is_numbered_across_splits(spark, scratch):
    """One file of many blocks, read by several tasks: the numbers are those of the lines in it."""
    ends = ["\n", "\r\n", "\r", "\n\n"]
    raw = "\ufeff" + "".join(f"line {i} {'x' * (i * 37 % 200)}\u00e9{ends[i * i % 4]}" for i in range(900)) + "last"
    data = raw.encode().replace(b"line 500 ", b"line \xff500 ")
    write(f"{scratch}/raw/xa/big.txt", data)
    write(f"{scratch}/raw/xa/small.txt", "one\ntwo\n")
    write(f"{scratch}/raw/xa/blank.txt", "\n")
    big = data.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    want = [("big.txt", i, x, False, "\ufffd" not in x) for i, x in enumerate(big)] + [
        ("blank.txt", 0, "", True, True), ("small.txt", 0, "one", True, True), ("small.txt", 1, "two", True, True)]
    conf, old = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    keys = []
    try:
        for size in ("134217728", "50000", "1000"):
            spark.conf.set(conf, size)
            df = src.read_language_files(spark, f"{scratch}/raw", ["xa"])
            rows = [tuple(r) for r in df.selectExpr("regexp_extract(source, '[^/]+$', 0) f", "line_no", "line", "valid_utf8",
                                                    "valid_line").orderBy("f", "line_no").collect()]
            assert rows == want
            assert df.rdd.getNumPartitions() >= {"134217728": 1, "50000": 2, "1000": 40}[size]
            keys.append({(r["doc_id"], r["line_no"]) for r in df.collect()})
    finally:
        spark.conf.set(conf, old)
    assert keys[0] == keys[1] == keys[2] and len(keys[0]) == len(want)


def test_split_files_are_in_shuffled_order(spark, scratch):
    rows = [(i, k, f"<xa> line {i} {k}") for i in range(60) for k in range(5)]
    split = exact_split(spark.createDataFrame(rows, "doc_id long, line_no long, text string").repartition(7), ["doc_id", "line_no"])
    order = [r["text"] for r in shuffled(split.drop("shuffle_key"), ["doc_id", "line_no"]).orderBy("shuffle_rank").collect()]
    of = {r["text"]: r["split"] for r in split.collect()}
    for files in (1, 6):
        io.write_splits(split, f"{scratch}/out{files}", key_cols=["doc_id", "line_no"], files=files)
        for name in ("train", "valid", "test"):
            parts = sorted(p for p in os.listdir(f"{scratch}/out{files}/split={name}") if p.startswith("part-"))
            read = "".join(open(f"{scratch}/out{files}/split={name}/{p}", encoding="utf-8").read() for p in parts)
            assert read.splitlines() == [t for t in order if of[t] == name]
            assert len(parts) <= files


def test_files_to_split_files(spark, scratch):
    """Three languages of raw files end up in the same splits, however they are partitioned."""
    for lang in ("xa", "xb", "xc"):
        for k in range(3):
            write(f"{scratch}/raw/{lang}/{k}.txt", "".join(f"{i}. {lang} line {k} {i}\n" for i in range(40)) + "!!\n7.\n")
    lines = src.read_language_files(spark, f"{scratch}/raw", ["xa", "xb", "xc"])
    found = []
    for parts in (1, 4, 64):
        split = prepare_corpus(lines.repartition(parts))
        found.append(sorted((r["text"], r["split"]) for r in split.select("text", "split").collect()))
        assert {r["split"]: r["n_lines"] for r in split_summary(split).collect()} == {"train": 288, "valid": 36, "test": 36}
    assert found[0] == found[1] == found[2] and len(found[0]) == 360
    io.write_splits(split, f"{scratch}/out")
    for name in ("train", "valid", "test"):
        back = sorted(r["text"] for r in src.read_split_text(spark, f"{scratch}/out", name).collect())
        assert back == [t for t, s in found[0] if s == name]
        assert all(t.startswith(("<xa> xa line", "<xb> xb line", "<xc> xc line")) for t in back)


def test_nonempty_lines(spark, scratch):
    write(f"{scratch}/l.txt", b"  a \n\n\xc2\xa0\nb\xff\n")
    assert [r["line"] for r in src.read_nonempty_lines(spark, f"{scratch}/l.txt").collect()] == ["a", "b\ufffd"]


def test_gold_file_to_boundary_tables(spark, scratch):
    path = f"{scratch}/xa_gold.tsv"
    write(path, "word\tsegments\nunlocked\t un|lock|ed \nNA\tN|A\nnull\tnull\n")
    gold = src.read_gold_tsv(spark, path)
    assert [tuple(r) for r in gold.collect()] == [("unlocked", ["un", "lock", "ed"]), ("NA", ["N", "A"]), ("null", ["null"])]
    language = src.gold_language(path)
    assert language == "xa"
    words = bd.score_words(gold, [tk.Chunk3Tokenizer(), tk.PretokTokenizer()])
    io.write_boundary_csvs(words.repartition(3), bd.macro_summary(words), f"{scratch}/b", language)
    back = spark.read.option("header", True).csv(f"{scratch}/b/word_level")
    assert {r["language"] for r in back.collect()} == {"xa"} and back.count() == 6
    cut = back.filter("tokenizer = 'chunk3' and word = 'unlocked'").first()
    assert (cut["gold_boundaries"], cut["predicted_boundaries"], cut["f1"]) == ("2,6", "3,6", "0.5")
    assert spark.read.option("header", True).csv(f"{scratch}/b/summary").count() == 2
    write(f"{scratch}/bad.tsv", "word\tsegs\nx\ty\n")
    with pytest.raises(ValueError, match="segments"):
        src.read_gold_tsv(spark, f"{scratch}/bad.tsv")
    with pytest.raises(FileNotFoundError):
        src.read_gold_tsv(spark, f"{scratch}/missing.tsv")


def test_split_and_metrics_round_trip(spark, scratch):
    df = spark.createDataFrame([("<xa> a", "train"), ("<xa> b", "test"), ("<xb> c", "valid")],
                               "text string, split string")
    io.write_splits(df, f"{scratch}/splits")
    assert sorted(r["text"] for r in src.read_split_text(spark, f"{scratch}/splits", "train").collect()) == ["<xa> a"]
    rep = spark.createDataFrame([("all", "t", 3, 1.0, 2.0, 0.0, 0.5, 1.5, 1.0, 2.0)],
                                src.METRICS_SCHEMA)
    io.write_metrics_csv(rep, f"{scratch}/m")
    assert src.read_metrics_csv(spark, f"{scratch}/m").collect() == rep.collect()
    io.write_json_metrics(spark, {"eval_loss": 1.5}, f"{scratch}/j")
    assert io.read_json_metrics(spark, f"{scratch}/j") == {"eval_loss": 1.5}


def test_document_lines_keys(spark):
    docs = spark.createDataFrame([(1, "a\nb\r\nc\rd", "en", "s")], "doc_id long, text string, lang string, source string")
    rows = src.document_lines(docs).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
