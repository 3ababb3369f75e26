"""A training corpus from documents: each stage is one operator of lattica.llm whose decisions
take effect, written and read again before the next."""

from __future__ import annotations

import public_tokenizers

import lattica
from lattica.llm import blocks, decontamination, near_dedup, packing, substring_dedup, toxicity
from lattica.llm.textops import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(spark, docs):
    lattica.ship(spark)
    return docs.select(*COLUMNS)


def without_toxic(spark, docs, sf_dir):
    """Rows that aren't toxic, by a model fitted on the labelled rows among them. Null and empty texts
    stay, repeated rows are judged alike and all stay or go; without labels nothing is toxic; an
    empty table stays empty. Columns other than COLUMNS aren't handed on, here and below."""
    docs = _documents(spark, docs)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark, docs, sf_dir):
    """The smallest doc_id of each class of near duplicates. Rows that repeat id and text are one; an id
    with several texts is several documents; texts without words and rows with a null id are
    nobody's duplicates and stay; an empty table stays empty."""
    return near_dedup.without_duplicates(_documents(spark, docs))


def without_repeated_passages(spark, docs, sf_dir):
    """Texts without the words of windows of 13 that a smaller doc_id has too; a text that loses all its
    words goes, others stay, with n_chars of what is left. Null and empty texts stay as they are,
    equal ids take nothing from each other, and a null id comes after all others."""
    return substring_dedup.without_repeats(_documents(spark, docs))


def without_benchmark(spark, docs, sf_dir):
    """Rows in which no window of the benchmark occurs, however long they are: each row is judged by its
    own text, whatever its id. Null and empty texts stay; an empty benchmark leaves all rows."""
    return decontamination.without_contaminated(_documents(spark, docs), table(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    """Pieces of sequences of 2048 tokens, as `packing.SCHEMA` has them: each token of each row, with its
    closing id, in one piece. A null text is its closing id alone; null and repeated ids are packed
    row by row; an empty table gives no pieces."""
    return packing.pack(_documents(spark, docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Near duplicates, the fitted model and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = blocks.written(docs, name)
    return docs
