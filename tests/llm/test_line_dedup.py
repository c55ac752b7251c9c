import random
import re
from collections import defaultdict

from stackroom.llm import line_dedup as L


def brute(docs):
    """(doc, line_no) -> (class's first line, number of links, copies, removed), for distinct ids."""
    lines = defaultdict(list)
    for doc_id, text in docs:
        for n, line in enumerate(text.split("\n") if text is not None else []):
            lines[tuple(w for w in re.split(r"[\W_]+", line.lower()) if w)].append((doc_id, n))
    blank = lines.pop((), [])
    tokens = {w: {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} for w in lines}
    root = {w: w for w in lines}
    links = defaultdict(set)

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    every = list(lines)
    for i, a in enumerate(every):
        for b in every[:i]:
            shared = len(tokens[a] & tokens[b])
            if shared / (len(tokens[a]) + len(tokens[b]) - shared) >= L.SIMILARITY - 1e-9:
                root[find(a)] = find(b)
                links[a].add(b), links[b].add(a)
    classes = defaultdict(list)
    for w in lines:
        classes[find(w)] += lines[w]
    out = dict.fromkeys(blank, (None, 0, None, False))
    for w, places in lines.items():
        later = any(min(lines[x]) < min(places) for x in links[w])
        out |= {at: (min(classes[find(w)]), len(links[w]), len(places), later or at != min(places)) for at in places}
    return out


def check(rows):
    def run(docs):
        got = {(r.doc_id, r.line_no): (tuple(r.class_at) if r.class_at else None, r.n_links, r.copies, r.removed) for r in rows.collect()}
        assert got == brute(docs)

    return run


def varied(seed, n_docs, vocabulary, changes):
    rng = random.Random(seed)
    stems = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    docs = []
    for d in range(n_docs):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(stems))
            for _ in range(rng.randrange(changes)):
                line[rng.randrange(len(line))] = f"x{rng.randrange(10**6)}"
            lines.append(" ".join(line) + rng.choice(["", ".", "!"]))
        docs.append((d, "\n".join(lines)))
    return docs


def test_equals_brute_force(spark, docs_of):
    for seed, vocabulary in ((1, 10_000), (2, 6)):
        docs = varied(seed, 60, vocabulary, 4)
        check(L.similar_lines(docs_of(docs))[0])(docs)


def test_many_near_copies_of_one_line(spark, docs_of, words):
    line = words(0, 80).split()
    docs = [(0, words(0, 80))] + [(i, " ".join(line[: i % 80] + [f"edit{i}"] + line[i % 80 + 1 :])) for i in range(1, 200)]
    check(L.similar_lines(docs_of(docs))[0])(docs)


def test_repeated_words(spark, docs_of):
    texts = ["ha ha ha ha ha", "ha ha ha ha ha ha", "a b a b a b", "0 0 0 0 0 0", "b a b a b a b", "a b a b a b a", "ha ha ha", "0 0 0 0 0", "a b c a b c a b", "a b c a b c a", "one two three four five"]
    docs = list(enumerate(texts))
    check(L.similar_lines(docs_of(docs))[0])(docs)


def test_edges(spark, docs_of, words):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "One. two"), (5, "one TWO"), (6, words(0, 30_000)), (7, words(0, 30_000) + " more"), (8, "é\nÉ")]
    check(L.similar_lines(docs_of(docs))[0])(docs)
    assert L.similar_lines(docs_of([]))[0].isEmpty()


def test_later_matches_go_only_if_they_match(spark, docs_of, words):
    """a ~ b ~ c, but not a ~ c: c stands before b and matches nothing earlier, so that only b goes."""
    a, b, c = words(0, 100), words(0, 90) + " " + words(200, 210), words(0, 80) + " " + words(300, 310) + " " + words(200, 210)
    rows, links = L.similar_lines(docs_of([(1, a), (2, c), (3, b)]), similarity=0.7)
    assert {r.doc_id: (r.class_at.doc_id, r.n_links, r.removed) for r in rows.collect()} == {1: (1, 1, False), 2: (1, 1, False), 3: (1, 2, True)}
    assert links.count() == 2


def test_a_frequent_token_is_dealt_to_several_tasks(spark, docs_of, words, monkeypatch):
    monkeypatch.setattr(L, "DEALT", 8)
    monkeypatch.setattr(L, "CARRIED", 3)
    docs = [(i, f"{words(0, 70)} {words(1000 + 9 * i, 1000 + 9 * i + i % 9)}") for i in range(60)]
    check(L.similar_lines(docs_of(docs))[0])(docs)


def test_pairs_do_not_grow_with_a_shared_passage(spark, docs_of, words):
    """Lines that share a passage but are not similar make no pairs beyond those that pass the filters."""

    def pairs(n):
        docs = docs_of([(i, f"{words(0, 60)} {words(1000 + 60 * i, 1030 + 60 * i)}") for i in range(n)]).selectExpr("doc_id AS doc", "doc_id AS row", "text")
        sets = L.token_sets(docs, L.raw_lines(docs).select("raw").distinct())
        return L.candidates(L.postings(sets, L.frequencies(sets), L.SIMILARITY), L.SIMILARITY).count()

    assert pairs(40) == pairs(160) == 0


def test_repeated_rows(spark, docs_of, words):
    rows = L.similar_lines(docs_of([(1, words(0, 9)), (1, words(0, 9)), (None, words(0, 9)), (2, "own")]))[0].collect()
    assert sorted((str(r.doc_id), r.copies, r.removed) for r in rows) == [("1", 3, True), ("1", 3, True), ("2", 1, False), ("None", 3, False)]


def test_kept_texts(spark, docs_of, words):
    rows = [(1, f"{words(0, 30)}\nown line"), (2, f"other\n{words(0, 31)}\n"), (3, None), (4, "own line"), (5, ""), (5, "mine"), (5, "mine")]
    docs = docs_of(rows).selectExpr("*", "1 AS row", "2 AS line_no", "'x' AS first")
    got = sorted(((r.doc_id, r.text) for r in L.kept_texts(docs).collect()), key=str)
    assert got == sorted([(1, f"{words(0, 30)}\nown line"), (2, "other\n"), (3, None), (4, ""), (5, ""), (5, "mine"), (5, "")], key=str)
