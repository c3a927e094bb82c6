"""Every stage of the pipeline against brute force on what its predecessor kept, and the whole run."""

import hashlib
import random

import public_tokenizers
import pytest
from test_exact import shingles
from test_repeats import removed
from tokenizers import Tokenizer

import corpus_pipeline
from kairoscope.llm import quality_crf
from kairoscope.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, __hit long, __dropped string, kept string, `group` int"


@pytest.fixture(scope="module")
def sf_dir(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 9)))
    line = lambda: " ".join(word() for _ in range(r.randint(6, 14))).capitalize() + "."
    junk = lambda: " ".join("".join(r.choice("#$%&@0123456789|~") for _ in range(r.randint(3, 12))) for _ in range(8))
    passage, item = " ".join(line() for _ in range(8)), " ".join(word() for _ in range(24))
    texts = {i: "\n".join(line() for _ in range(r.randint(2, 9))) for i in range(70)}
    texts |= {i: "\n".join(junk() for _ in range(r.randint(2, 9))) for i in range(70, 100)}
    texts |= {100 + i: texts[i] for i in range(8)} | {110 + i: texts[i] + f" {word()}" for i in range(8, 12)}
    texts |= {i: texts[i] + "\n" + passage + "é" * i for i in (40, 41, 42, 43)}
    texts |= {i: texts[i] + "\n" + " ".join("other" if k == 5 else w for k, w in enumerate(item.split())) for i in (50, 51)}
    rows = [*texts.items(), (200, None), (201, ""), (None, passage), (None, texts[1])]
    path = scratch_path(spark, "pipeline-test")
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, "x", "k", 3) for i, t in rows], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 70 or i >= 100), 0) for i in texts if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def kept_by(spark, docs, sf_dir, name):
    return [tuple(x) for x in dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).select(*docs.columns).collect()]


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(x) for x in docs.collect()]

    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = quality_crf.score_texts(model, [x[1] for x in rows])
    want = [x for x, s in zip(rows, good, strict=True) if s >= corpus_pipeline.QUALITY_THRESHOLD]
    same(kept_by(spark, docs, sf_dir, "quality classifier"), want)
    assert {x[0] for x in want if x[0] is not None and x[0] < 70} == set(range(70)) and not {x[0] for x in want} & set(range(70, 100))

    sets = {x[0]: shingles(x[1]) for x in rows if x[0] is not None}
    part = {i: i for i in sets}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    want = [x for x in rows if x[0] is None or part[x[0]] == x[0]]
    same(kept_by(spark, docs, sf_dir, "n-gram Jaccard join"), want)
    assert len(want) < len(rows) - 8

    want = []
    for x, (_, _, n, _, left) in zip(rows, removed([x[:2] for x in rows]), strict=True):
        text = left.decode("utf-8", "ignore") if n else x[1] or ""
        want.append((x[0], text, *x[2:4], len(text), *x[5:]))
    same(kept_by(spark, docs, sf_dir, "suffix-array dedup"), want)

    same(kept_by(spark, docs, sf_dir, "benchmark decontamination"), [x for x in rows if x[0] not in (50, 51)])

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for x in rows:
        ids = library.encode(x[1] or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((x[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = corpus_pipeline.encoded(spark, docs, sf_dir)
    same([tuple(x) for x in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()], want)


def test_run(spark, sf_dir):
    got = [x.doc_id for x in corpus_pipeline.run(spark, sf_dir).collect()]
    assert len(got) == len(set(got)) + 1 and got.count(None) == 2
    # 51 stays: its passage of the benchmark was cut out as a repeat of 50.
    assert {*range(50), 51} <= set(got) and not set(got) & {50, *range(70, 100), *range(100, 108)}


def test_run_of_nothing(spark, sf_dir):
    path = scratch_path(spark, "pipeline-empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
