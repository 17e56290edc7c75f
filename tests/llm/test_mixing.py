import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from penstroke.llm import mixing as M

from .conftest import words


def h(*parts):
    return int(hashlib.md5("|".join([M.SEED, *map(str, parts)]).encode()).hexdigest()[:8], 16)


def brute(rows, weights=None, shards=None):
    """doc_id, source, shard, block, tokens of the mixture, with plain loops."""
    one = {}
    for d, t, s in rows:
        if d is not None and t and t.split():
            one[d] = min(one.get(d, (s or "", len(t.split()))), (s or "", len(t.split())))
    n = sum(1 for d, t, s in rows if d is not None and t and t.split())
    shards = shards or max(1, -(-n // M.SHARD_DOCS))
    cut = []
    for key in {(h("shard", d) % shards, s) for d, (s, _) in one.items()}:
        total = 0
        for d in sorted((d for d, (s, _) in one.items() if (h("shard", d) % shards, s) == key), key=lambda d: (h("order", d), d)):
            cut.append((d, key[1], key[0], total // M.BLOCK_TOKENS, one[d][1]))
            total += one[d][1]
    tokens = {}
    for _, s, _, _, k in cut:
        tokens[s] = tokens.get(s, 0) + k
    weight = {s: float(k) ** M.TEMPERATURE for s, k in tokens.items()} if weights is None else {s: w for s, w in weights.items() if s in tokens and w > 0}
    out = []
    for shard in {c[2] for c in cut}:
        have = {s: -(-sum(c[4] for c in cut if c[2] == shard and c[1] == s) // M.BLOCK_TOKENS) for s in weight}
        have = {s: b for s, b in have.items() if b}
        if not have:
            continue
        whole, scarce = sum(weight[s] for s in have), []
        for s in sorted(have, key=lambda s: (have[s] / weight[s], s)):
            if sum(weight[x] for x in [*scarce, s]) > whole * M.TOLERANCE:
                break
            scarce.append(s)
        rest = [s for s in have if s not in scarce]
        budget = int(sum(have[s] for s in scarce) + min(have[s] / weight[s] for s in rest) * sum(weight[s] for s in rest) + 1e-9)
        quota = dict.fromkeys(have, 0)
        for _ in range(budget):
            open_ = [s for s in have if quota[s] < have[s]]
            if not open_:
                break
            quota[max(sorted(open_), key=lambda s: weight[s] / (2 * quota[s] + 1))] += 1
        for s in have:
            size = {}
            for c in cut:
                if c[2] == shard and c[1] == s:
                    size[c[3]] = size.get(c[3], 0) + c[4]
            want = quota[s] * M.BLOCK_TOKENS
            order = sorted(size, key=lambda b: (h("block", shard, s, b), b))
            chosen, total = [], 0
            for b in order:
                total += size[b]
                if total > want:
                    break
                chosen.append(b)
            left, total = want - sum(size[b] for b in chosen), 0
            for b in order:
                if b not in chosen and size[b] <= 2 * M.BLOCK_TOKENS:
                    total += size[b]
                    if 2 * total - size[b] > 2 * left:
                        break
                    chosen.append(b)
            out += [c for c in cut if c[2] == shard and c[1] == s and c[3] in chosen]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, rng.choice([3, 40, 200]))), f"s{min(rng.randrange(9), 4)}") for i in range(400)]
    return rows + [(900, None, "s0"), (901, "", "s0"), (902, "  \n", "s1"), (903, "null source here", None), (None, "no id", "s0"), rows[5], rows[5], (904, "w " * 9000, "s2")]


def got(df):
    return sorted((r.doc_id, r.source, r.shard, r.block, r.n_tokens) for r in df.collect())


def test_equal_to_plain_loops(make_docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 300)
    rows = corpus()
    assert got(M.selected(make_docs(rows))) == brute(rows)
    monkeypatch.setattr(M, "SHARD_DOCS", 100)
    want = brute(rows)
    assert len({x[2] for x in want}) > 2 and got(M.selected(make_docs(rows))) == want
    weights = {"s0": 3.0, "s1": 1.0, "s2": 0.0, "unknown": 5.0}
    assert got(M.selected(make_docs(rows), weights)) == brute(rows, weights)


def test_shares_follow_the_weights(make_docs, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 100)
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, 20)), f"s{i % 3}") for i in range(900)]
    weights = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    tokens = {}
    for _, s, _, _, n in got(M.selected(make_docs(rows), weights)):
        tokens[s] = tokens.get(s, 0) + n
    for s, w in weights.items():
        assert abs(tokens[s] / sum(tokens.values()) - w) < 0.02


@pytest.mark.parametrize("shards", [None, 1, 5])
def test_sql_says_the_same(make_docs, tmp_path, monkeypatch, shards):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 300)
    docs = make_docs(corpus())
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = con.execute(f"SELECT doc_id, source, shard, block, n_tokens FROM ({M.selected_sql(shards)})").fetchall()
    assert got(M.selected(docs, shards=shards)) == sorted(want) == brute(corpus(), shards=shards)
    assert len({x[2] for x in want}) == (shards or 1)


def test_token_shares_of_the_documents_are_those_of_the_target(spark):
    """Over the whole table of sf0.1, which holds documents of up to 20,000 tokens."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tokens = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(M.token_count(F.col("text"))).alias("n")).collect()}
    weight = {s: n**M.TEMPERATURE for s, n in tokens.items()}
    kept = {r.source: r.n for r in M.selected(docs).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    for s, w in weight.items():
        assert abs(kept[s] / sum(kept.values()) / (w / sum(weight.values())) - 1) < 0.01
    assert sum(kept.values()) > 0.9 * sum(tokens.values())


def test_a_rare_source_does_not_limit_the_others(make_docs):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 100)), f"s{i % 5}") for i in range(2000)]
    all_ = sum(x[4] for x in got(M.selected(make_docs(rows))))
    rare = got(M.selected(make_docs(rows + [(5000, "a few words of a rare source", "rare")])))
    assert sum(x[4] for x in rare) >= 0.99 * all_
    hot = rows + [(10_000 + i, " ".join(words(rng, 100)), "hot") for i in range(4000)]
    kept = {}
    for _, s, _, _, n in got(M.selected(make_docs(hot + [(5000, "a few words of a rare source", "rare")]))):
        kept[s] = kept.get(s, 0) + n
    # the five sources that are scarce against the power of 0.7 give all they have
    assert all(kept[f"s{i}"] >= 0.97 * 40_000 for i in range(5)) and kept["hot"] > 150_000


def test_defined_cases(make_docs):
    rows = corpus()
    docs = make_docs(rows)
    for name in ("shard", "block", "n_tokens", "quota", "weight", "__o", "__r", "__in"):
        docs = docs.withColumn(name, F.lit("c"))
    out = M.mix(docs)
    inside = {x[0] for x in brute(rows)}
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(d for d, _, _ in rows if d in inside)
    assert M.selected(make_docs([])).count() == 0 and M.mix(make_docs([])).count() == 0
