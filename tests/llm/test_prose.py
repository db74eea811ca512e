import pytest

from codeloom.llm import prose as P

COMMON = "the of and to in a is that it was with on not this are from but which they you her all one so when who no into your its over we how our than der die und das nicht ist zu den mit sich auf el la de que y en los se no por con は の を に".split()
SENTENCES = [
    "The parser reads the header of the file before the first tick.", "When the storm begins, our importer drops a list of seats and nobody notices.", "It took 2.4 ms for 4419 rows, so we kept the old layout.",
    "The weather layer replaces the wrong socket because the flag is never cleared.", "What happens when a boat sinks with its crew still on board?", "Der Importer liest den Preis der Ladung, weil die Markierung nie gelöscht wird.",
]
PROSE = {
    "plain": " ".join(SENTENCES),
    "wrapped": "The parser reads the header of the\nfile before the first tick. When the storm\nbegins, our importer drops a list of seats\nand nobody notices.",
    "comment": "\n".join("// " + s for s in SENTENCES),
    "quoted": "\n".join("> " + s for s in SENTENCES),
    "bullets": "\n".join("- " + s for s in SENTENCES),
    "chat": "\n".join(s.lower().rstrip(".?") for s in SENTENCES),
    "japanese": "索引は地図を読み込む前に何も返さないことがある。\n荷物の待ち行列は保存のたびに最後の状態を上書きする。",
}
OTHER = {
    "table": "| Anchor | Socket |\n| --- | --- |\n| the spare boats | 2.26 |\n| HandleBudget | no |\n" * 4,
    "values": "Tide,Rate,Owner\nthe spare boats,no,4755\nits parent,yes,655\n" * 5,
    "list": "\n".join(f"({c}) Depth of the header of the file." for c in "abcdefgh"),
    "code": "class Boat\n{\n    int Crew = 3;\n    // keep in step with the seat table\n    void Sail(int a)\n    {\n        Crew = a;\n    }\n};\n" * 3,
    "settings": "[/Script/Editor.Queue]\nCargoScore=True\nTideToken=636\n" * 4,
    "log": "17:05:28 WARN worker-0 push /Game/Docks/T_Metal 310ms\n17:05:31 DEBUG worker-5 mark /Game/Docks/T_Field 330ms\n" * 4,
    "repetition": "The parser reads the header of the file before the first tick. " * 9,
    "words": "click here " * 40,
    "salad": "that the with one her are this from you into we how than all so not over is the it " * 6,
    "junk": "=_o||O#.=| |#_=_O\\*-\\-o_.\n#-.= O#///=*__ #\n" * 6,
    "base64": "uCY36sDkeTKpSDauWlhIMQ1QOJ2oFIXdxan/v16fPNPGKanYJZHPL8CnAfTwnFctk1d4Y8/TojfG\n" * 6,
}
BLANK = {"none": None, "empty": "", "blank": " \n\t　\n", "mark": "﻿"}


@pytest.fixture(scope="module")
def typed(spark):
    texts = PROSE | OTHER | BLANK
    rows = [(i, t) for i, t in enumerate(texts.values())] + [(900 + k, " ".join(SENTENCES[k % 3 :] + SENTENCES[: k % 5])) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_chars", "2 as votes")
    words = spark.createDataFrame([("x", w, 1) for w in COMMON] + [("x", None, 2)], "lang string, word string, word_rank int")
    by_id = {r.doc_id: r for r in P.text_types(frame, words).collect()}
    assert len(by_id) == len(rows)
    return {name: by_id[i] for i, name in enumerate(texts)}


@pytest.mark.parametrize("name", PROSE)
def test_prose(typed, name):
    assert typed[name].text_type == "prose"


@pytest.mark.parametrize("name", OTHER)
def test_other(typed, name):
    assert typed[name].text_type in ("other", "repetition")


@pytest.mark.parametrize("name", ["none", "empty", "blank"])
def test_blank(typed, name):
    assert typed[name].text_type == "empty" and typed[name].prose_share == 0


def described(text, common):
    return P.describe([text], P.Lexicon(common)).to_pylist()[0]


def test_statistics():
    row = described("The sea is big.\nno #tag here", ["the", "is", "no"])
    assert (row["n_chars"], row["n_words"], row["ending_share"], row["repeated"]) == (22, 7, 0.5, False)
    assert abs(row["mean_word_length"] - 20 / 7) < 1e-9 and abs(row["symbol_share"] - 1 / 22) < 1e-9 and abs(row["common_share"] - 3 / 7) < 1e-9
    assert sum(v["chars"] for v in row["votes"]) == 22


def test_texts_do_not_mix():
    """Figures do not depend on which texts stand beside a text."""
    texts = list(PROSE.values()) + ["", " \n"] + list(OTHER.values())
    together = P.describe(texts, P.Lexicon(COMMON)).to_pylist()
    assert together == [described(t, COMMON) for t in texts]


def test_functions_vote_on_what_they_know():
    def says(text):
        votes = P.unpacked([v["code"] for v in described(text, COMMON)["votes"]])
        return {name: set(votes[:, i].tolist()) for i, name in enumerate(P.NAMES)}

    assert says(OTHER["salad"])["salad"] == {0} and says(OTHER["salad"])["run_on"] == {0} and says(PROSE["plain"])["salad"] == {2}
    assert says(OTHER["words"])["loop"] == {0} and says(OTHER["log"])["log"] == {0}
    assert 0 in says(OTHER["list"])["entry"] and 0 in says(OTHER["list"])["list"] and says(PROSE["plain"])["entry"] == {2}
    assert 0 in says(OTHER["code"])["comment"] and says(PROSE["comment"])["comment"] == {2}
    assert 0 in says("Privet sosed kak tvoi dela segodnya utrom kogda solntse vstalo nad rekoi opyat")["bare"]
    assert P.describe(["a b c d e f g h i j k l m n"], P.Lexicon([])).to_pylist()[0]["votes"][0]["code"] % 3 == 2


def test_posteriors_follow_the_majority_of_good_functions():
    k = len(P.NAMES)
    code = lambda votes: sum(v * 3 ** (k - 1 - i) for i, v in enumerate(votes))
    good, bad = [1] * k, [0] * k
    flip = lambda base, i: [1 - v if j == i else v for j, v in enumerate(base)]
    counts = {code(good): 100.0, code(bad): 80.0} | {code(flip(good, i)): 5.0 for i in range(k)} | {code(flip(bad, i)): 5.0 for i in range(k)}
    post = P.learn(counts)
    assert post[code(good)] > 0.99 and post[code(bad)] < 0.01 and post[code(flip(good, 2))] > 0.9 and post[code(flip(bad, 2))] < 0.1
    assert P.learn({}) == {}


def test_very_long_texts_are_read_whole():
    long = " ".join(SENTENCES) * 2000
    assert described(long, COMMON)["n_chars"] == len("".join(long.split()))
    assert described("x" * 500_000, [])["n_words"] == 1
    assert sum(v["chars"] for v in described("word " * 100_000, [])["votes"]) == 400_000


def test_too_many_common_words(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_COMMON", 1)
    with pytest.raises(ValueError):
        P.text_types(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a",), ("b",)], "word string"))


def test_nothing(spark):
    words = spark.createDataFrame([], "lang string, word string")
    assert P.text_types(spark.createDataFrame([], "doc_id long, text string"), words).collect() == []
    assert [r.text_type for r in P.text_types(spark.createDataFrame([(1, "== ##"), (1, "== ##")], "doc_id long, text string"), words).collect()] == ["other", "other"]
