"""Languages of several scripts, and alphabets too large for a dense table."""

import random
import re

from test_learned import _phrases

from scribelake.llm import cross_parsing

SCRIPTS = {
    "latin": "abcdefghijklmnopqrstuvwxyzàâäáéèêëíîïóôöúûüñçß",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "arabic": "ءابتثجحخدذرزسشصضطظعغفقكلمنهوي",
}


def test_two_languages_in_each_of_three_scripts(spark):
    r = random.Random(8)
    rows = []
    # The rarer scripts have fewer documents: their letters are not among the most frequent.
    for (script, letters), n in zip(SCRIPTS.items(), (160, 80, 20)):
        for k in range(2):
            words = ["".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(150)]
            rows += [(len(rows) + i, " ".join(r.choice(words) for _ in range(60)), f"{script}{k}") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {x["id"]: x["lang_pred"] for x in cross_parsing.languages(docs).collect()}
    assert [i for i, _, lang in rows if got[i] != lang] == []


def test_sparse_tables_equal_substring_search():
    r = random.Random(3)
    signs = [chr(0x4E00 + 7 * k) for k in range(700)]
    texts = ["".join(r.choice(signs[:400]) for _ in range(1500)), "".join(r.choice(signs[300:]) for _ in range(1500)), "the cat sat on the mat"]
    model = cross_parsing.Model("".join(sorted({c for t in texts for c in t if c.isalpha()})), ["a", "b", "c"], texts)
    tries = [texts[0][40:300] + texts[1][9:70], "the mat " + texts[1][700:1400], "ж" + texts[0][:9] + " 12 ж", "x"]
    got, _ = model.phrases(tries)
    assert [type(t).__name__ for _, t in model._tables] == ["Sparse", "Sparse", "Dense"]
    for t, row in zip(tries, got):
        plain = re.sub(r"[\W\d_]+", " ", t).lower()
        for j, known in enumerate(texts):
            assert row[j] == sum(_phrases(plain[k : k + cross_parsing.SEGMENT], known) for k in range(0, len(plain), cross_parsing.SEGMENT))
