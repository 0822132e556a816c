"""The pipeline's stages, one by one and all together, against brute force."""

import hashlib
import os
import random

import pytest
import sentencepiece
from test_operators import LANGS, naive_contamination, near_truth, normal, prose

import corpus_pipeline
from logstrata.llm import common
from logstrata.llm.queries import piece_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, lang_pred int, carried_0 string"
ITEMS = [(1, prose(70, 30)), (2, prose(71, 6)), (3, None), (None, prose(72, 20))]


def edited(text, k, seed):
    words, rng = text.split(), random.Random(seed)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def documents():
    texts = [None, "", " \n", "12 34 !", "a", "A"]
    for i in range(40):
        texts.append(prose(300 + i, 20 + i, LANGS[sorted(LANGS)[i % 3]]))
    for i in range(12):  # copies but for blanks, and near copies
        texts += [texts[6 + i].replace(" ", "  \t"), edited(texts[40 - i], 1, i), edited(texts[45], 1 + i % 9, 50 + i)]
    texts += [f"{prose(90, 60)} {ITEMS[0][1]}", f"{prose(91, 400)} {ITEMS[1][1]}", f"{prose(92, 10)} {ITEMS[1][1]}", ITEMS[3][1].upper(), prose(93, 9000), prose(93, 9000) + " end"]
    rng = random.Random(1)
    rows = [(i, t, rng.choice([*LANGS, None]), "s", None, f"k{i % 3}", i, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[7], (None, prose(94, 30), None, None, None, None, None, None), (None, prose(94, 30), None, None, None, None, None, None)]


def key(row):
    return (row[0] is None, row[0] or 0, str(row))


def brute_language(rows):
    return [r for r in rows if any(c.isalpha() for c in r[1] or "")]


def brute_exact(rows):
    first = {}
    for r in sorted(rows, key=key):
        first.setdefault(normal(r[1]), r)
    return list(first.values())


def brute_near(rows):
    """One row of each component, of its least id; which of several with this id is not said."""
    kept = [(doc, least) for (doc, _, least), n in near_truth([r[:2] for r in rows], 5, 80).items() for _ in range(n)]
    ids = sorted({least for doc, least in kept if doc == least and doc is not None})
    return [next(r for r in sorted(rows, key=key) if r[0] == i) for i in ids] + [r for r in rows if r[0] is None][:1]


def brute_benchmark(rows):
    found = [(r, naive_contamination(r[1], ITEMS)) for r in rows]
    return [r for r, (n, hit, _) in found if not (hit and 20 * hit >= n)]


BRUTE = [brute_language, brute_exact, brute_near, brute_benchmark]


def digests(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    out = []
    for doc, text, *_ in rows:
        ids = library.encode(text or "")
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def shown(df):
    return sorted(map(str, map(tuple, df.collect())))


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_one_by_one(spark, folder):
    rows = documents()
    for (_, stage), brute in zip(corpus_pipeline.STAGES, BRUTE, strict=False):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
        got = stage(spark, docs, folder)
        assert got.schema.names == docs.schema.names
        wanted = brute(rows)
        assert 0 < len(wanted) < len(rows)
        assert shown(got) == sorted(str(tuple(r)) for r in wanted)
        rows = wanted
    _, last = corpus_pipeline.STAGES[-1]
    got = last(spark, spark.createDataFrame(rows, SCHEMA), folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == digests(rows)


def test_whole_pipeline(spark, folder):
    rows = documents()
    for brute in BRUTE:
        rows = brute(rows)
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file:")))
    got = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == digests(rows)
    left = set(os.listdir(common.shared_dir(spark).removeprefix("file:"))) - before
    assert [name.split("-")[0] for name in left] == ["pipeline"]  # scratch tables are gone
    (kept,) = left
    assert os.listdir(f"{common.shared_dir(spark).removeprefix('file:')}/{kept}") == ["4-sentencepiece"]


def test_a_stage_deletes_the_scratch_of_the_one_before(spark, folder, tmp_path):
    there = lambda: set(os.listdir(common.shared_dir(spark).removeprefix("file:")))
    docs, before = spark.createDataFrame(documents(), SCHEMA), there()
    (_, exact), (_, near) = corpus_pipeline.STAGES[1:3]
    lazy = exact(spark, docs, folder)
    own = there() - before
    assert own and {name.split("-")[0] for name in own} >= {"recipes"}
    n = near(spark, lazy, folder).count()  # not stored: its tables are still needed
    assert own <= there()
    lazy.write.parquet(str(tmp_path / "stored"))
    found = near(spark, spark.read.parquet(str(tmp_path / "stored")), folder)
    assert not own & there() and found.count() == n
    foreign = docs.withMetadata("doc_id", {common._SCRATCH: ["../documents.parquet", "x", "a-" + "0" * 32]})  # what others wrote there names no folder of ours
    common.let_go(foreign)
    assert os.path.isdir(f"{folder}/documents.parquet")


def test_stages_of_nothing(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), folder).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None)] * 3, SCHEMA)
    for (_, stage), n in zip(corpus_pipeline.STAGES, (0, 1, 3, 3, 3), strict=True):
        assert stage(spark, nulls, folder).count() == n


def test_two_scratch_scopes_do_not_meet(spark):
    with common.scratch(spark):
        outer = common.materialise(spark.range(3), "outer")
        with common.scratch(spark):
            common.materialise(spark.range(2), "inner")
        assert outer.count() == 3
