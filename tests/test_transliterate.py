import random

from pyspark.sql import functions as F

from leafgrid.functions.transliterate import TABLE, ascii_fold, tables


def slow(word):
    one, many = tables()
    out, i = "", 0
    while i < len(word):
        for n in (2, 1):
            if len(word[i : i + n]) == n and word[i : i + n] in many:
                out += many[word[i : i + n]]
                i += n
                break
        else:
            out += one.get(word[i], word[i])
            i += 1
    return out.strip(" ")


def test_longest_match_from_the_left(spark):
    rng = random.Random(3)
    letters = [*TABLE, "a", "B", " ", "é", "Ü", "ǆ", "ﬁ", "日", "🙂", "Ω", "Щ", "Ё", "ά", "́", "１", "𝗁", "½", "\n"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(600)] + ["plain", "", None]
    found = [r.f for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(ascii_fold(F.col("w")).alias("f")).collect()]
    assert found == [None if w is None else slow(w) for w in words]


def test_known_words(spark):
    cases = {"Straße": "Strasse", "naïve": "naive", "Œuvre": "Oeuvre", "щука": "shchuka", "ЩУКА": "ShchUKA", "Γουργούρης": "Gourgouris", "ﬁn": "fin", "Łódź": "Lodz", "𝗃𝗈𝗁𝗇": "john", "é": "e", "日本": "日本", " a ": "a"}
    rows = spark.createDataFrame(list(cases.items()), "w string, want string").select("*", ascii_fold(F.col("w")).alias("f"), ascii_fold(F.col("w"), "?").alias("q")).collect()
    assert [(r.w, r.f) for r in rows if r.f != r.want] == []
    assert {r.q for r in rows if r.w == "日本"} == {"??"} and all(r.q.isascii() for r in rows)
