import random
import re

import pytest

from quillmask.llm import jaccard_join as jj
from quillmask.llm.set_index import HOT_SETS
from quillmask.llm.tables import Scratch, components, trim_driver

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, s) in enumerate(known):
        for j, t in known[:k]:
            both = len(s & t)
            if 100 * both >= 75 * (len(s) + len(t) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def family(rng, n, size, edits):
    """Texts that differ from one another in a few words, in chains and stars."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = [base]
    for _ in range(n - 1):
        words = list(rng.choice(out))
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        out.append(words[: max(1, len(words) - rng.randrange(3))])
    return [" ".join(w) for w in out]


@pytest.mark.parametrize(("seed", "hot", "per_part"), [(1, HOT_SETS, 100), (2, 3, 400), (3, 5, 10**6)])
def test_components_equal_brute_force(spark, seed, hot, per_part):
    rng = random.Random(seed)
    passage = " ".join(f"common{i}" for i in range(60))
    texts = []
    for _ in range(6):
        texts += family(rng, rng.randrange(2, 30), rng.randrange(6, 120), 3)
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) for _ in range(40)]
    texts += [passage.upper(), passage, "", None, " \n", "one", "One", "one two three four", "one two three four five"]
    rng.shuffle(texts)
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[0]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS sig", "2 AS n", "'x' AS component_id").repartition(3)
    got = sorted((tuple(r) for r in jj.jaccard_components(df, hot, per_part).collect()), key=str)
    assert got == brute(rows)


def test_components_by_stars(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(0, i) for i in range(400, 460)] + [(i, i + 1) for i in range(500, 540)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert sorted(map(tuple, found)) == sorted((x, find(x)) for x in {x for a, b in edges if a != b for x in (a, b)})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jj.jaccard_components(df).collect() == []


def test_large_groups_of_several_components_leave_few_pairs(spark, monkeypatch):
    """Texts in one long chain: each is similar to a few others of its lists only, so no set can stand for a list."""
    rng = random.Random(5)
    words, rows = [f"w{k}" for k in range(150)], []
    for i in range(400):
        words[rng.randrange(150)] = f"v{i}"
        rows.append((i, " ".join(words)))
    left, written = [], Scratch.written

    def counted(self, df, name, wide=False):
        out = written(self, df, name, wide)
        if name == "open":
            left.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "written", counted)
    found = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    assert sum(left) < 100


def test_driver_gives_back_what_its_jvm_allocates(spark):
    assert trim_driver(spark)
