import re

import pyarrow as pa
import pytest
import regex
import tiktoken

import corpus_pipeline
from retort.llm import bpe, decontaminate, quality, secrets, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near dedup", "decontamination", "secret scan", "bpe encoding"]


def brute(spark, sf):
    """The pipeline's rows by plain loops over Python lists (the learned rules are taken as given)."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    rules = quality.learned_rules(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    x = quality.statistics(pa.array([d["text"] for d in docs]))

    def rejected(row):
        return any(all((row[quality.STATS.index(c.stat)] >= c.bound) == c.at_least or row[quality.STATS.index(c.stat)] == c.bound for c in r) for r in rules)

    docs = [d for d, row in zip(docs, x, strict=True) if row[1] > 0 and not rejected(row)]
    a, b, _ = simhash.signatures(pa.array([d["text"] for d in docs]))
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if bin(int(a[i] ^ a[j])).count("1") <= simhash.TAU and bin(int(b[i] ^ b[j])).count("1") <= simhash.TAU_PAIRS and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    docs = [d for k, d in enumerate(docs) if group[k] == k]
    clean = lambda t: regex.sub(r"[^\p{L}\p{N}]+", " ", t.lower()).strip()
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        grams |= {p for p in decontaminate.windows(clean(r.text), decontaminate.N_WORDS, decontaminate.MIN_WORDS)}
    docs = [d for d in docs if not any(g in f" {clean(d['text'])} " for g in grams)]
    owners, found = {}, {}
    for d in docs:
        for _, _, pattern, _ in secrets.PATTERNS:
            for s in re.findall(pattern, d["text"]):
                owners.setdefault(s, set()).add(d["source"])
                found.setdefault(d["doc_id"], set()).add(s)
    for d in docs:
        for s in sorted(found.get(d["doc_id"], ())):
            if len(owners[s]) < secrets.MIN_OWNERS and not re.search(secrets.PLACEHOLDER, s) and len(set(s)) >= secrets.MIN_DISTINCT:
                d["text"] = d["text"].replace(s, secrets.MASK)
    codec = bpe._codec(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens) if t}, special_tokens={})
    return {d["doc_id"]: other.encode_ordinary(d["text"]) for d in docs}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_run_equals_brute_force(spark, sf, size):
    path = f"{sf}/../{size}"
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, path).collect()}
    assert got == brute(spark, path)


def test_stages_keep_columns_and_take_edge_rows(spark, sf, edge):
    docs = edge.select(*COLUMNS, "_row", "key")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        counts.append(docs.count())
        if name != "bpe encoding":
            assert docs.columns == [*COLUMNS, "_row", "key"]
    assert counts[0] >= counts[1] >= counts[2] == counts[3] == counts[4] > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge.select(*COLUMNS).limit(0), sf).count() == 0

