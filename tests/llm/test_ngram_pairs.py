"""Every link, and ids that carry several texts, against the query's SQL or force."""

import random

import duckdb
import pytest

from fungo.llm.components import components
from fungo.llm.ngram_join import NgramJoin
from fungo.llm.queries import NEAR_SQL
from test_ngram_join import brute, corpus, found, shingles

A, B, C = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon",
           "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty",
           "red green blue white black brown grey pink violet orange gold silver copper iron tin lead zinc nickel cobalt chrome")


@pytest.mark.parametrize("rows", [
    [(1, A), (1, B), (2, A + " near"), (3, B + " near")],
    [(4, C), (5, C), (5, A), (6, A + " near"), (5, "")],
    [(9, A), (9, B), (9, C), (2, C + " near"), (7, B), (8, "x")]])
def test_an_id_with_several_texts(spark, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert found(spark, rows) == sorted(con.execute(NEAR_SQL).fetchall(), key=str)


def test_every_pair(spark):
    rows = corpus(3) + [(1000 + i, " ".join([*A.split(), *B.split(), str(i)])) for i in range(30)] + [(1, A), (2, A), (2000, A)]
    sets = [(d, shingles(t)) for d, t in rows]
    want = {(min(d, e), max(d, e)) for d, x in sets for e, y in sets if d != e and x and y and 100 * len(x & y) >= 75 * len(x | y)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in NgramJoin(docs).pairs().collect()) == sorted(want)


def test_a_large_group_is_no_square(spark):
    """Copies that are too far from each other: the join of tokens makes rows in proportion, and results stay."""
    rows = family(300)
    join = NgramJoin(spark.createDataFrame(rows, "doc_id long, text string"))
    leading = join.leading()
    # most have more tokens of their own than a link allows, so their reach is below their size
    near = leading.select("node", "n", "reach").distinct()
    assert near.where("reach < n").count() > 100
    groups = components(join.verified(join.leader_pairs(0, None)))
    groups = components(join.verified(join.leader_pairs(0, None)).union(join.verified(join.centre_pairs(leading, groups))))
    rows_ = join.grouped(leading, groups)
    opened = join.opened(rows_, join.matrix(rows_))
    assert opened.count() < 900
    assert found(spark, rows) == brute(rows)


def family(n):
    """A text of 100 words and copies of it with up to 4 words changed."""
    r = random.Random(7)
    base = [f"w{i}" for i in range(100)]
    out = [(0, " ".join(base))]
    for d in range(1, n):
        text = list(base)
        for at in r.sample(range(100), r.choice((1, 2, 4, 4))):
            text[at] = f"x{d}y{at}"
        out.append((d, " ".join(text)))
    return out
