import random

import pytest
from pyspark.sql import functions as F

from penstroke.llm import token_counts as C
from penstroke.llm.queries import VOCABULARY


def viterbi(word, pieces):
    """Fewest assumptions: every cover of the marked word, piece by piece, from all starts."""
    path = C.MARK + word
    best = [(0.0, 0)] + [None] * len(path)
    for end in range(1, len(path) + 1):
        size = len(path[end - 1].encode())
        options = [(best[end - 1][0] + C.BYTE_SCORE * size, best[end - 1][1] + size)]
        for begin in range(end - 1, -1, -1):
            if path[begin:end] in pieces:
                options.append((best[begin][0] + pieces[path[begin:end]], best[begin][1] + 1))
        best[end] = max(options, key=lambda x: x[0])
    return best[-1][1]


@pytest.fixture(scope="module")
def pieces():
    return C.load_pieces(VOCABULARY)


def test_shared_prefixes_give_the_scores_of_single_words(pieces):
    rng = random.Random(1)
    letters = "aaeeiionrstlhd'é-ßñ漢🙂"
    made = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(1500)} | {"the", "then", "thence", "theory", "a" * 300})
    assert C.walk(made, C.with_suffixes(pieces)) == [viterbi(w, pieces) for w in made]


def test_counts_by_document(make_docs, pieces):
    rng = random.Random(2)
    vocabulary = ["the", "theory", "of", "naïve", "Strahlung", "x1", "漢字", "don't", "--", "🙂"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(80)]
    got = {r.doc_id: r.n_tokens for r in C.token_counts(make_docs(rows), VOCABULARY).collect()}
    assert got == {d: sum(viterbi(w, pieces) for w in t.split()) for d, t in rows}


def test_memory_of_words_does_not_change_counts(pieces, monkeypatch):
    rng = random.Random(3)
    vocab = sorted({"".join(rng.choice("abcdeth") for _ in range(5)) for _ in range(300)})
    want = C.Counter(pieces).count(vocab).tolist()
    monkeypatch.setattr(C, "KEPT_WORDS", 50)
    small = C.Counter(pieces)
    assert [int(small.count(vocab[i : i + 20])[j]) for i in range(0, 300, 20) for j in range(len(vocab[i : i + 20]))] == want
    assert small.count(vocab).tolist() == want


def test_defined_cases(make_docs, tmp_path):
    long = "ab" * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "the"), (4, "the"), (None, "the the"), (5, "word " * 100_000), (6, long)]
    docs = make_docs(rows).withColumn("n_tokens", F.lit("x")).withColumn("total", F.lit(0))
    out = C.token_counts(docs, VOCABULARY).collect()
    by = {r.doc_id: r.n_tokens for r in out}
    assert len(out) == len(rows) and by[1] is None and by[2] == by[3] == 0 and by[4] == 1 and by[None] == 2 and by[5] == 100_000 and by[6] > 0
    assert C.token_counts(make_docs([]), VOCABULARY).count() == 0
    with pytest.raises(Exception):
        C.token_counts(docs, str(tmp_path / "none.model"))
