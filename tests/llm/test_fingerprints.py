import hashlib
from collections import Counter

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from quillmask.llm import fingerprints as fp
from quillmask.llm.query_fingerprints import op7_fingerprints

TEXT = st.lists(st.sampled_from(["a", "bc", " ", "\n", "\n\n", "é", "word", "other", "\t"]), max_size=40).map("".join)


@given(TEXT, TEXT)
def test_roots_test_equality(a, b):
    x, y = fp.Tree(a), fp.Tree(b)
    assert (x.root == y.root) == (a == b) == (x.text() == y.text())
    assert 0 <= fp.likeness(x.text(), y.text()) <= 1 and fp.likeness(x.text(), x.text()) == 1


@given(TEXT)
def test_levels_join_up(text):
    tree, raw = fp.Tree(text), text.encode()
    for ends in (tree.phrase_ends.tolist(), tree.paragraph_ends, tree.section_ends):
        assert ends == sorted(set(ends)) and (ends[-1:] or [0])[0] == len(raw)
    assert set(tree.section_ends) <= set(tree.paragraph_ends) <= set(tree.phrase_ends.tolist())


def test_branches_locate_edits():
    a = fp.Tree("one two\nthree four\n\nfive six\nseven")
    b = fp.Tree("one two\nthree four\n\nfive SIX\nseven")
    places = fp.differing(a.text(), b.text())
    assert places == [(1, 0)] and a.ranges(places) == [(20, 29)] and fp.differing(a.text(), a.text()) == []


def leaves(text):
    return Counter(int(h >> 32) for h in fp.Tree(text).phrases.tolist())


@given(TEXT, TEXT)
def test_likeness_equals_phrases_in_common(a, b):
    """What sections and paragraphs have in common from the top down, their phrases have as well."""
    x, y = leaves(a), leaves(b)
    want = 1.0 if a == b else 2 * (x & y).total() / max(x.total() + y.total(), 1)
    assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - want) < 1e-12


@given(TEXT, TEXT)
def test_differing_branches_are_the_paragraphs_without_an_equal(a, b):
    x, y = (Counter(t.splitlines(keepends=True)) if "\n" in t or t else Counter() for t in (a, b))
    tree = fp.Tree(a)
    found = tree.ranges(fp.differing(tree.text(), fp.fingerprint(b)))
    assert Counter(a.encode()[i:j].decode() for i, j in found) <= x and sum(j > i for i, j in found) == (x - y).total()


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, xxhash.xxh64(r[1], seed=42).intdigest() + 2**63 & 2**64 - 1 if r[0] is None else r[0], r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        f = [fp.fingerprint(x) for x in (t, e, n)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f[0], f[1], fp.likeness(f[0], f[1]), fp.likeness(f[0], f[2])))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op7_fingerprints(spark, d).collect()), key=str) == brute(rows)


def test_many_groups_and_odd_rows(spark):
    rows = [(i * 7 % 90, f"text {i}\nof line " * (i % 5)) for i in range(90)] + [(5, None), (5, "x"), (5, "x"), (None, "no id"), (None, ""), (None, "a"), (None, "b"), (None, "b"), (10**12, "far")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS grp", "2 AS first", "3 AS ord")
    for size in (1, 3, 1000):
        assert sorted((tuple(r) for r in fp.fingerprint_documents(df, size).collect()), key=str) == brute(rows)
    assert fp.fingerprint_documents(df.limit(0)).collect() == []
    one = fp.fingerprint_documents(df.filter("text = 'far'")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_long_text_in_parts():
    text = "some words here " * 200_000
    assert fp.fingerprint(text) == fp.fingerprint(text + "")
    assert fp.likeness(fp.fingerprint(text), fp.fingerprint(text[:-1000] + "changed " * 100)) > 0.99
