"""Every operator on documents: null, empty and very long texts, repeated and missing ids, other columns of any name, no rows."""

import random

import pytest
from pyspark.sql import functions as F

from kairoscope.llm import bpe, decontaminate, fill_middle, jaccard_join, lm_score, minhash_dedup, quality_crf, suffix_dedup, token_alignment, winnow

#: Names that the operators use inside.
NAMES = ["group", "doc", "id", "row", "n", "node", "head", "sig", "key", "keys", "tokens", "chunk", "bucket", "h1", "__salt", "__parts", "item", "kept", "target", "score", "__hit", "start", "lang", "seed", "position"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghi") for _ in range(r.randint(2, 8)))
    long = "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(15_000))
    assert len(long) > 1_000_000
    texts = [" ".join(word() for _ in range(n)) for n in (3, 30, 60, 200)]
    return [(1, long), (2, long[300_000:700_000]), (3, texts[1]), (4, texts[1]), (4, texts[1]), (4, texts[2]), (5, None), (6, ""), (7, " \n\t"), (8, texts[3] + " é世👍"), (9, "x" * 200_000), (10, texts[0]), (None, texts[3]), (None, None), (12, texts[3] + " end")]


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "lm_score": lambda spark, d: lm_score.cross_entropy_difference(d, labels(spark).where("quality = 1")).select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss")]),
    "decontaminate": lambda spark, d: decontaminate.find_overlaps(d, spark.createDataFrame([(1, "abc de fgh " * 8), (2, "end"), (3, None)], "item_id long, text string")),
    "winnow": lambda spark, d: winnow.digest(winnow.edited_against_next(d)).select("doc_id", "n_chars", "edited_sha256", "fingerprint"),
    "suffix_dedup": lambda spark, d: suffix_dedup.digest(suffix_dedup.remove_repeats(d)),
    "bpe": lambda spark, d: bpe.digest(bpe.encode_decode(d)),
    "quality_crf": lambda spark, d: quality_crf.classify(d, labels(spark)),
    "jaccard_join": lambda spark, d: jaccard_join.near_duplicates(d),
    "token_alignment": lambda spark, d: token_alignment.align_tokens(d),
    "fill_middle": lambda spark, d: fill_middle.digest(fill_middle.transform(d)),
    "minhash_dedup": lambda spark, d: minhash_dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents_of_every_kind(spark, rows, name):
    plain = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    crowded = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])
    found = [sorted(map(repr, map(tuple, OPERATORS[name](spark, d).collect()))) for d in (plain, crowded)]
    assert found[0] == found[1]
    assert name == "decontaminate" or len(found[0]) in (len(rows), len(rows) - 2)  # some leave out rows without an id
    assert OPERATORS[name](spark, crowded.limit(0)).count() == 0


def test_contaminated_rows_leave_with_all_columns(spark, rows):
    crowded = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)])
    kept = decontaminate.remove_contaminated(crowded, spark.createDataFrame([(2, "end")], "item_id long, text string"))
    assert kept.columns == crowded.columns and kept.count() == len(rows) - 1
