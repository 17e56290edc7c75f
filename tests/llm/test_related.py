import random

import numpy as np
import pyarrow as pa

from penstroke.llm import packing as P
from penstroke.llm import related as R

from .conftest import words


def vectors(texts, idf=True):
    """Unit tf-idf vectors with document frequencies counted by word, exact."""
    code, rows = {}, []
    for t in texts:
        n = {}
        for w in t.lower().split():
            n[code.setdefault(w, len(code))] = n.get(code.setdefault(w, len(code)), 0) + 1
        rows.append(n)
    df = np.zeros(len(code))
    for n in rows:
        df[list(n)] += 1
    x = np.zeros((len(rows), len(code)))
    for r, n in zip(x, rows):
        r[list(n)] = np.log1p(list(n.values())) * (np.log1p(len(texts) / df[list(n)]) if idf else 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def true_neighbours(texts, k):
    x = vectors(texts)
    g = x @ x.T
    np.fill_diagonal(g, -1)
    return g, np.argsort(-g, axis=1)[:, :k]


def found(texts):
    """Neighbours within one leaf, and all cosines of the same weights by a plain matrix."""
    starts, h, c, _, _ = R.word_counts(pa.array(texts))
    df = np.bincount(h & np.uint32(R.BUCKETS - 1), minlength=R.BUCKETS)
    n = np.diff(starts).astype(np.int32)
    h, w = R.weights(n, (h << np.uint32(8)) | c, np.log1p(len(texts) / np.maximum(df, 1)))
    _, code = np.unique(h, return_inverse=True)
    x = np.zeros((len(texts), code.max() + 1))
    x[np.repeat(np.arange(len(n)), n), code] = w
    g = x @ x.T
    np.fill_diagonal(g, -1)
    return g, *R.cell_neighbours(np.arange(len(texts)), n, h, w, 6)


def corpus(n=1500):
    rng = random.Random(3)
    topics = [words(rng, 60, 50_000) for _ in range(40)]
    return [" ".join(rng.choices(topics[i % 40], k=80) + words(rng, 40, 2000)) for i in range(n)]


def test_a_cell_holds_the_true_neighbours_of_the_full_word_vectors(monkeypatch):
    monkeypatch.setattr(R, "DENSE", 50)
    texts = corpus(600)
    g, a, b, d = found(texts)
    assert len(a) == 600 * 6 and np.allclose(d, 2 - 2 * g[a, b], atol=1e-4)
    worst = np.sort(g, axis=1)[:, -6]
    assert (g[a, b] >= worst[a] - 1e-5).all()


def test_a_large_cell_is_searched_in_spans(monkeypatch):
    monkeypatch.setattr(R, "DENSE", 50)
    monkeypatch.setattr(R, "SPAN", 300)
    monkeypatch.setattr(R, "_ROWS", 64)
    texts = corpus(1000)
    g, a, b, d = found(texts)
    assert len(a) == 6000 and (a != b).all() and np.allclose(d, 2 - 2 * g[a, b], atol=1e-4)


def test_consecutive_documents_are_related_over_homes(make_docs, monkeypatch):
    monkeypatch.setattr(P, "HOME_DOCS", 200)
    monkeypatch.setattr(R, "LEAF", 150)
    texts = corpus()
    rows = P.pack(make_docs(list(enumerate(texts)))).collect()
    order = [d for _, d in sorted({(r.place, r.doc_id) for r in rows})]
    assert sorted(order) == list(range(1500))
    assert np.mean([x % 40 == y % 40 for x, y in zip(order, order[1:])]) > 0.8
    used = {r.window_id for r in rows}
    assert used == set(range(len(used))) and sum(r.n_tokens for r in rows) == 1500 * 120


def test_ends_are_joined_over_homes_by_the_shortest_edge():
    cells, numbers = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    head, tail = np.array([1, 4, 7, 9]), np.array([3, 4, 8, 9])
    a, b, d = np.array([3, 7, 4, 9, 1]), np.array([8, 4, 9, 3, 9]), np.array([0.1, 0.2, 0.3, 0.05, 0.4], np.float32)
    order, turned, chain = R.link(cells, numbers, head, tail, a, b, d)
    # 9-3 first; then 3 is taken, so 3-8 is not; 7-4, 4-9 make one chain of all
    assert chain.tolist() == [0, 0, 0, 0]
    ends = [(int(tail[i]), int(head[i])) if t else (int(head[i]), int(tail[i])) for i, t in zip(order, turned)]
    assert ends in ([(1, 3), (9, 9), (4, 4), (7, 8)], [(8, 7), (4, 4), (9, 9), (3, 1)])
    assert R.link(cells, numbers, head, tail, *(np.zeros(0, t) for t in (np.int64, np.int64, np.float32)))[2].tolist() == [0, 1, 2, 3]


def test_recall_against_full_cosine_on_the_documents(spark):
    """All of the given documents, every text with words; the graph's neighbours against exact tf-idf cosine."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = R.word_table(docs)
    member = R.members(table)
    idf = R.inverse_frequencies(table, table.count())
    node = R.nodes(table, member).toArrow()
    ids = node.column("doc_id").to_numpy()
    batch = node.combine_chunks().to_batches()[0]
    n, v = R._words(batch)
    a, b, _ = R.cell_neighbours(ids, n, *R.weights(n, v, idf), 6)
    text = {r.doc_id: r.text for r in docs.collect()}
    bare = [" ".join(w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—") or w for w in text[i].split()) for i in ids.tolist()]
    g, near = true_neighbours(bare, 6)
    got = [set() for _ in ids]
    for x, y in zip(a.tolist(), b.tolist()):
        got[x].add(y)
    recall = np.mean([len(got[i] & set(near[i].tolist())) / 6 for i in range(len(ids))])
    assert recall >= 0.9, recall
    # and through the leaves, here one
    at = R.centres(table, idf, len(ids), P.HOME_DOCS)
    assert at.count == 1


def bag_of(text):
    """Normalised words of a text, in order."""
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…–—"
    return tuple(sorted(w.lower().strip(marks) or w.lower() for w in text.split()))


def plain(rows, size):
    """Pieces of the windows with plain loops over all pairs: only for a corpus of one home."""
    texts = {}
    for d, t in rows:
        if d is not None and t and t.split():
            texts[d] = max(texts.get(d, ""), t)
    bags = {}
    for d in sorted(texts):
        bags.setdefault(bag_of(texts[d]), []).append(d)
    reps = sorted(c[0] for c in bags.values())
    copies = {c[0]: c for c in bags.values()}
    alltexts = [t for d, t in rows if d is not None and t and t.split()]
    df = {}
    for t in alltexts:
        for w in set(bag_of(t)):
            df[w] = df.get(w, 0) + 1
    weight = {}
    for d in reps:
        n = {}
        for w in bag_of(texts[d]):
            n[w] = n.get(w, 0) + 1
        x = {w: np.log1p(k) * float(np.float16(np.log1p(len(alltexts) / df[w]))) for w, k in n.items()}
        size_ = np.sqrt(sum(v * v for v in x.values()))
        weight[d] = {w: v / size_ for w, v in x.items()}
    near = {}
    for d in reps:
        dot = sorted((-sum(v * weight[e].get(w, 0.0) for w, v in weight[d].items()), e) for e in reps if e != d)
        near[d] = [(2 + 2 * s, e) for s, e in dot[:6]]
    edges = {}
    for d in reps:
        for s, e in near[d]:
            edges.setdefault(d, {})[e] = s
            edges.setdefault(e, {})[d] = s
    order, seen = [], set()
    for start in sorted(reps, key=lambda d: (len(edges.get(d, {})), d)):
        at = start
        while at is not None and at not in seen:
            seen.add(at)
            order.append(at)
            at = next((e for s, e in sorted((s, e) for e, s in edges.get(at, {}).items()) if e not in seen), None)
    out, place, token = [], 0, 0
    for d in order:
        for c in copies[d]:
            n = len(texts[c].split())
            first = 0
            while first < n:
                k = min(n - first, size - token % size)
                out.append((token // size, place, c, first, k))
                first, token = first + k, token + k
            place += 1
    return sorted(out)


def test_the_whole_query_equals_plain_loops(make_docs):
    rng = random.Random(6)
    rows = []
    for i in range(90):
        rows.append((i * 7, " ".join(words(rng, rng.choice([5, 20, 60]), 150))))
    rows += [(1000 + i, rows[i % 4][1]) for i in range(30)]
    rows += [(2000, " ".join(reversed(rows[8][1].split()))), (2001, None), (2002, "  "), (None, "w1 w2"), rows[5], rows[5]]
    got = [(r.window_id, r.place, r.doc_id, r.first_token, r.n_tokens) for r in P.pack(make_docs(rows), 128).collect()]
    want = plain(rows, 128)
    assert {d for _, _, d, _, _ in got} == {d for _, _, d, _, _ in want}
    # copies follow one another in any order
    bag = {d: bag_of(t) for d, t in rows if t}
    assert sorted((w, p, bag[d], f, n) for w, p, d, f, n in got) == sorted((w, p, bag[d], f, n) for w, p, d, f, n in want)


def test_copies_are_one_node_and_stay_together(make_docs):
    rng = random.Random(2)
    rows = [(i, "the same words again and again") for i in range(400)] + [(1000 + i, " ".join(words(rng, 30, 200))) for i in range(50)]
    out = P.pack(make_docs(rows), 64).collect()
    places = sorted({r.place for r in out if r.doc_id < 400})
    assert places == list(range(places[0], places[0] + 400))
    assert sorted({r.place for r in out}) == list(range(450)) and sum(r.n_tokens for r in out) == 400 * 6 + 50 * 30


def test_large_leaves_are_split_by_sign_and_hash(monkeypatch):
    monkeypatch.setattr(R, "LEAF", 20)
    monkeypatch.setattr(R, "MOST_CENTRES", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, R.SKETCH)).astype(np.float32)
    x[:1500] = x[0] + 1e-3 * x[:1500]
    at = R.Centres(x[rng.permutation(4000)[:600]], 4000, 100)
    assert len(at.at) <= 16 and at.bits.max() > 0 and len(at.salted)
    leaves, home = at.route(R._unit(x), np.arange(4000))
    assert leaves.shape == (4000, R.COPIES) and 0 <= leaves.min() and leaves.max() < at.count and home.max() < at.homes
    assert np.bincount(leaves[:, 0]).max() < 8 * 4 * R.LEAF


def test_grouped_centres_find_nearly_the_same(monkeypatch):
    monkeypatch.setattr(R, "LEAF", 5)
    rng = np.random.default_rng(4)
    topics = R._unit(rng.normal(size=(300, R.SKETCH)))
    x = R._unit(topics[rng.integers(0, 300, 6000)] + 0.02 * rng.normal(size=(6000, R.SKETCH))).astype(np.float32)
    at = R.Centres(x[:3000], 3000, 1000)
    assert at.groups is not None
    assert np.mean(at.closest(x, 1)[:, 0] == R._closest(x, at.at, 1)[:, 0]) > 0.95


def test_a_cell_of_any_size_holds_all_true_neighbours(monkeypatch):
    """Pieces along one order left out the pairs that were far apart in it."""
    monkeypatch.setattr(R, "DENSE", 50)
    monkeypatch.setattr(R, "SPAN", 100)
    monkeypatch.setattr(R, "_ROWS", 32)
    texts = corpus(1000)
    g, a, b, d = found(texts)
    assert len(a) == 6000 and np.allclose(d, 2 - 2 * g[a, b], atol=1e-4)
    worst = np.sort(g, axis=1)[:, -6]
    assert (g[a, b] >= worst[a] - 1e-5).all()


def graph(make_docs, texts):
    """Neighbours of each text as the query finds them, through leaves, parts and cells; and the centres."""
    table = R.word_table(make_docs(list(enumerate(texts))))
    member = R.members(table)
    idf = R.inverse_frequencies(table, table.count())
    at = R.centres(table, idf, len(texts), 10_000)
    edges, nodes = {}, []
    for r in R.candidates(R.nodes(table, member), at, idf, 6).collect():
        if r.block:
            nodes += R._unpack(r.payload, np.int64, np.int64, np.int64)[0].tolist()
        else:
            a, b, _, d = R._unpack(r.payload, np.int64, np.int64, np.int32, np.float32)
            for x, y, z in zip(a.tolist(), b.tolist(), d.tolist()):
                edges.setdefault(x, {})[y] = z
    assert sorted(nodes) == list(range(len(texts)))
    return {x: set(sorted(y, key=y.get)[:6]) for x, y in edges.items()}, at


def test_parts_of_a_leaf_lose_no_pair(make_docs, monkeypatch):
    """A leaf that is cut by hash of the id: each two nodes of it meet in one cell at least, and all neighbours are found."""
    monkeypatch.setattr(R, "SPAN", 100)
    monkeypatch.setattr(R, "PART", 120)
    texts = corpus(700)
    got, at = graph(make_docs, texts)
    assert len(at.at) == 1 and at.times.tolist() == [6] and at.cells == at.plain + 15
    g, near = true_neighbours(texts, 6)
    assert np.mean([len(got[i] & set(near[i].tolist())) / 6 for i in range(700)]) > 0.99
    part = at.plain + np.arange(6)
    node, cell, side = at.meet(part)
    inside = [n for n, s in zip(node.tolist(), side.tolist()) if s % 2 == 0]
    assert sorted(inside) == list(range(6)) and cell.min() >= at.plain and cell.max() < at.cells
    pairs = [tuple(sorted(node[cell == c].tolist())) for c in np.unique(cell)]
    assert sorted(pairs) == [(i, j) for i in range(6) for j in range(i + 1, 6)]


def test_leaves_grow_until_they_hold_the_true_neighbours(make_docs, monkeypatch):
    """Texts of random words have no groups: small leaves lose most of their neighbours."""
    rng = random.Random(8)
    texts = [" ".join(words(rng, 60, 400)) for _ in range(800)]
    monkeypatch.setattr(R, "LEAF", 40)
    monkeypatch.setattr(R, "SPAN", 200)
    got, at = graph(make_docs, texts)
    g, near = true_neighbours(texts, 6)
    assert np.mean([len(got[i] & set(near[i].tolist())) / 6 for i in range(800)]) >= 0.9


def test_words_are_squeezed_without_loss():
    v = np.array([5 << 8 | 1, 9 << 8 | 255, 3 << 8 | 2, 0xFFFFFF07, 7], np.uint32)
    assert R.unsqueeze(R.squeeze(v)).tolist() == v.tolist() and len(R.unsqueeze(R.squeeze(v[:0]))) == 0


def test_bands_that_are_not_compared_by_all_words_keep_their_near_copies(monkeypatch):
    monkeypatch.setattr(R, "SPAN", 200)
    monkeypatch.setattr(R, "RARE", 50)
    rng = random.Random(12)
    texts = [" ".join(words(rng, rng.choice([4, 90]), 6000)) for _ in range(500)]
    long = [i for i, t in enumerate(texts) if t.count(" ") > 50]
    copies = {len(texts) + k: i for k, i in enumerate(long[:40])}
    texts += [" ".join(texts[i].split()[:-5] + words(rng, 5, 6000)) for i in copies.values()]
    starts, h, c, _, _ = R.word_counts(pa.array(texts))
    n, v = np.diff(starts).astype(np.int32), (h << np.uint32(8)) | c
    idf = np.log1p(len(texts) / np.maximum(np.bincount(h & np.uint32(R.BUCKETS - 1), minlength=R.BUCKETS), 1)).astype(np.float16)
    row = np.arange(len(texts))
    bands = R.Bands(np.array([20]), np.array([[True, True], [True, False]]))
    vectors = lambda r: (n[r], *R.weights(n[r], v[R._places(starts, n, r)], idf))
    whole = {(a, b): d for a, b, d in zip(*(x.tolist() for x in R.tiled_neighbours(row, vectors, 6)))}
    a, b, d = R.tiled_neighbours(row, vectors, 6, bands=(bands.of(n), bands.wanted, lambda x: R.rare(x, idf)))
    found = {(x, y): z for x, y, z in zip(a.tolist(), b.tolist(), d.tolist())}
    assert len(found) == len(a) and all((i, j) in found and (j, i) in found for i, j in copies.items())
    cosine = lambda x, y: R.pair_cosines(*vectors(np.array([x])), *vectors(np.array([y])))[0]
    assert all(abs(2 - 2 * cosine(x, y) - z) < 1e-4 for (x, y), z in list(found.items())[::50])
    short = {i for i in row.tolist() if n[i] < 20}
    # whoever is short has met all
    assert np.mean([k in found for k in whole if k[0] in short]) > 0.99


def test_less_than_all_pairs_hold_the_true_neighbours_of_texts_without_groups(make_docs, monkeypatch):
    """Texts of random words in three languages and of all lengths: comparing nearly all pairs isn't needed."""
    rng = random.Random(5)
    zipf = [1 / (k + 3) for k in range(3000)]
    texts = []
    for i in range(1800):
        mark = "xyz"[i % 3]
        texts.append(" ".join(f"{mark}{k}" for k in rng.choices(range(3000), zipf, k=int(4 * 1.5 ** rng.uniform(0, 11)))))
    texts = list(dict.fromkeys(texts))
    monkeypatch.setattr(R, "LEAF", 60)
    monkeypatch.setattr(R, "SPAN", 200)
    got, at = graph(make_docs, texts)
    g, near = true_neighbours(texts, 6)
    assert np.mean([len(got.get(i, set()) & set(near[i].tolist())) / 6 for i in range(len(texts))]) >= 0.9
    bands = getattr(at, "bands", None)
    assert at.compared * (bands.wanted.mean() if bands else 1) < 0.4 * len(texts) ** 2
