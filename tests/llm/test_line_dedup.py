import random

from cohortspark.llm.line_dedup import SQL, deduplicate_lines, drop_shared_lines, op7_line_dedup
from helpers import awkward_texts, clashing, documents
from oracle import connect, difference

BLANKS = " \t\n\x0b\x0c\r"


def plain(texts, min_docs=2):
    def key(line):
        return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))

    held = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    gone = {k: min(d) for k, d in held.items() if len(k) >= 10 and len(d) >= min_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i)) for i, t in texts]


def shared_texts():
    rng = random.Random(3)
    lines = ["  Shared line number one", "SHARED LINE NUMBER ONE\t", "short", "", "another long line", "Éclair éclair", "ten chars!"]
    return awkward_texts() + ["\n".join(rng.choice(lines + [f"own {i} own {i}"]) for _ in range(rng.randint(1, 12))) for i in range(40)]


def test_lines(spark):
    texts = list(enumerate(shared_texts()))
    docs = clashing(documents(spark, shared_texts()))
    for least in (2, 5):
        rows = deduplicate_lines(docs, min_docs=least).collect()
        assert sorted((r.row.doc_id, r.text) for r in rows) == plain(texts, least)
    kept = drop_shared_lines(docs)
    assert kept.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in kept.collect())


def test_repeated_rows_missing_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a line of text\nb"), (1, "a line of text\nb"), (None, "a line of text"), (2, "a line of text")], "doc_id long, text string")
    rows = sorted(((r.row.doc_id or 99), r.text, r.n_dropped) for r in deduplicate_lines(docs).collect())
    assert rows == [(1, "a line of text\nb", 0), (1, "a line of text\nb", 0), (2, "", 1), (99, "", 1)]
    assert deduplicate_lines(docs.limit(0)).count() == 0


def test_query_equals_sql(spark, tmp_path):
    documents(spark, shared_texts()).coalesce(1).write.parquet(f"{tmp_path}/t")
    import glob
    import shutil

    shutil.copy(glob.glob(f"{tmp_path}/t/*.parquet")[0], f"{tmp_path}/documents.parquet")
    assert difference(op7_line_dedup(spark, str(tmp_path)), connect(str(tmp_path)), SQL) is None
