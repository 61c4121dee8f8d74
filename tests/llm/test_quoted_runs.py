"""Quotations of several lines against a search in every earlier message."""

import random

from solarloom.llm.quotations import link_quotations

SCHEMA = "conv_id int, turn int, text string"


def links(spark, rows):
    return {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.parent_turn, r.root_turn) for r in link_quotations(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_parts_of_a_message(spark):
    got = links(spark, [
        (1, 0, "l1\nl2\nl3\nl4"), (1, 1, "> l1\n> l2\nanswer\n> L3\n>  l4\nagain"), (1, 2, "> l2\n> l4"), (1, 3, "> l4\n> l5"), (1, 4, "> answer\n> again"),
        (2, 0, "one\n\ntwo wrapped\nhere\n\nthree\nfour"), (2, 1, "> two\n> wrapped here\nyes"), (2, 2, "> here\n>\n> three\nno"), (2, 3, "> four\n> one"),
        (3, 0, "> l1\n> l2"), (None, 0, "l1\nl2"), (None, 1, "> l1\n> l2")])
    assert got[1, 1] == (2, 2, 0, 0) and got[1, 4] == (1, 1, 1, 0)
    assert got[1, 2] == (1, 0, None, 2) and got[1, 3] == (1, 0, None, 3)
    assert got[2, 1] == (1, 1, 0, 0) and got[2, 2] == (1, 1, 0, 0) and got[2, 3] == (1, 0, None, 3)
    assert got[3, 0][1] == 0 and got[None, 1][1] == 0


def test_runs_of_lines(spark):
    rnd = random.Random(3)
    said = [[[rnd.choice("abc") for _ in range(rnd.randrange(1, 9))] for _ in range(25)] for _ in range(4)]
    asked = [[[rnd.choice("abc") for _ in range(rnd.randrange(1, 6))] for _ in range(25)] for _ in range(4)]
    rows = [(c, t, "\n".join([f"> {x}" for x in asked[c][t]] + said[c][t])) for c in range(4) for t in range(25)]
    got = links(spark, rows + rows[:5])
    for c in range(4):
        for t in range(25):
            q = asked[c][t]
            fits = [u for u in range(t) if any(said[c][u][i : i + len(q)] == q for i in range(len(said[c][u])))]
            assert got[c, t][1:3] == (len(fits) > 0, max(fits, default=None))
