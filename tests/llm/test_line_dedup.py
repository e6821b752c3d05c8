import random

import pytest
import xxhash

from quillmask.llm import line_dedup as ld
from quillmask.llm.set_index import HOT_SETS
from tests.llm.test_jaccard_join import WORD, family, shingle_set


def key(text):
    """The hash by which rows that share an id are told apart and ordered."""
    h = xxhash.xxh64(text, seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def brute(rows):
    lines = sorted({(i, key(t), k, x) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n"))})
    seen, gone = [], set()
    for i, d, k, x in lines:
        if len(WORD.findall(x)) < ld.MIN_WORDS:
            continue
        s = shingle_set(x)
        if any(100 * len(s & t) >= 75 * len(s | t) for t in seen):
            gone.add((i, d, k))
        seen.append(s)
    out = []
    for i, t in rows:
        lost = {k for k in range(len((t or "").split("\n"))) if t is not None and (i, key(t), k) in gone}
        out.append((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in lost), len(lost)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "hot", "per_part"), [(1, HOT_SETS, 200), (2, 4, 500)])
def test_lines_equal_brute_force(spark, seed, hot, per_part):
    rng = random.Random(seed)
    lines = []
    for _ in range(8):
        lines += family(rng, rng.randrange(2, 25), rng.randrange(6, 80), 3)
    passage = " ".join(f"common{i}" for i in range(50))
    lines += [passage, passage.upper(), "  " + passage, *(passage + f" tail{i} more{i}" for i in range(20)), "", "short line", "short line", "one two three four", "one two three four five", "One two three four five "]
    rng.shuffle(lines)
    texts = ["\n".join(rng.sample(lines, rng.randrange(1, 6))) for _ in range(60)]
    rows = [*((i * 3, t) for i, t in enumerate(texts)), (3, texts[1]), (None, passage), (500, None), (501, ""), (502, "\n\n" + passage + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "'de' AS lang", "text", "1 AS lines_removed", "2 AS line").repartition(3)
    got = ld.dedup_lines(df, hot=hot, per_part=per_part)
    assert got.columns == ["doc_id", "lang", "text", "line", "lines_removed"]
    assert sorted(((r.doc_id, r.text, r.lines_removed) for r in got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_equal_short_lines_match(spark):
    long = "one two three four five six seven"
    rows = [(1, f"All rights reserved.\n{long}\nHome"), (2, f"all  RIGHTS reserved.\nAll rights\n\n \n{long}"), (3, "Home\nHome page\n\nAll rights reserved. now"), (4, f"All rights reserved.\n{long}\nHome")]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text, r.lines_removed) for r in got) == [(1, rows[0][1], 0), (2, "All rights\n\n ", 2), (3, "Home page\n\nAll rights reserved. now", 1), (4, "", 3)]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    shared, own = "one two three four five six seven", "UNIQUE words that exist in no other line of table"
    rows = [(0, f"{shared}\nfirst words of the first document here"), (1, f"{own}\nand more words of this one alone"), (1, f"{shared}\nwords that follow in the other text"), (1, f"{shared}\nwords that follow in the other text"), (1, None), (None, shared)]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS _gone", "3 AS line")).collect()
    assert sorted(((r.doc_id, r.text, r.lines_removed) for r in got), key=str) == brute(rows)
    assert (1, f"{own}\nand more words of this one alone", 0) in [(r.doc_id, r.text, r.lines_removed) for r in got]


def test_very_long_lines_and_many_lines(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    many = "\n".join(f"line number {i % 900} of this long text" for i in range(4000))
    rows = [(1, long), (2, "x\n" + long + " more"), (3, many), (4, many)]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = {r.doc_id: (r.text, r.lines_removed) for r in got}
    assert left[1] == (long, 0) and left[2] == ("x", 1) and left[4] == ("", 4000) and left[3][1] >= 3100
