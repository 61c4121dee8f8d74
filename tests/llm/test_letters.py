"""Letters outside the basic plane."""

import random

from solarloom.llm.languages import identify_language, letter_classes


def test_letters_above_the_basic_plane(spark):
    rnd = random.Random(2)
    latin, adlam = "abcdefghij", [chr(0x1E922 + i) for i in range(20)]
    rows = [(i, " ".join("".join(rnd.choice(adlam if i % 2 else latin) for _ in range(5)) for _ in range(20)), "ff" if i % 2 else "en") for i in range(120)]
    rows.append((120, "\U0001F600 \U0001F601", "en"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i][0] == ("ff" if i % 2 else "en") and got[i][1] > 0 for i in range(120))
    assert got[120] == ("und", 0.0)
    table = letter_classes()
    assert table[0x1E900] == table[0x1E922] > 0 and table[0x20000] > 0 and table[0x1F600] == 0
