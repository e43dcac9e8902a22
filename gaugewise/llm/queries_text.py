"""Queries of the operators on texts and pages."""

from __future__ import annotations

import public_tokenizers

from gaugewise.llm import bpe, html, secrets, toxicity
from gaugewise.llm.common import table
from gaugewise.llm.registry import query


@query("op2_toxic_kernel")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_html_text")
def op3(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


@query("op4_secret_spans")
def op4(spark, sf_dir):
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


@query("op10_bpe_transducer")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")))
