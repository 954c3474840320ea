import random
import re
from html import unescape

import pytest
from frames import rows
from pyspark.sql import functions as F

from revtide.functions import markers as M
from revtide.functions import wikitext as W
from revtide.operators import talk, templates
from revtide.schemas import TEMPLATES


def _texts(spark, *texts):
    return spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "page_id long, revision_id long, revision_text string")


def test_nested_templates(spark):
    frame = _texts(spark, "{{cite web|u={{harvid|A}}}} {{ Advert \n|d=1}}{{}}", None, "none")
    got = frame.orderBy("revision_id").select(
        W.extract_templates(F.col("revision_text")).alias("a"),
        W.reliability_templates(F.col("revision_text"), TEMPLATES).alias("b"),
    ).collect()
    assert [set(r.a) if r.a is not None else None for r in got] == [{"cite web", "Advert", ""}, None, set()]
    assert [r.b for r in got] == [["Advert"], None, None]


def test_tagged_rows_keep_name_and_lower_case(spark):
    frame = spark.createDataFrame(
        [(1, "A page", 9, 1, "{{Advert}}{{advert|x}}"), (1, "A page", 9, 2, None)],
        "page_id long, page_title string, user_id long, revision_id long, revision_text string",
    )
    got = templates.revisions_with_template(frame)
    assert rows(got, "page_title", "revision_id", "col", "template") == [
        ("A_page", 1, "Advert", "advert"), ("A_page", 1, "advert", "advert"),
    ]


def test_sections(spark):
    got = talk.talk_sections(_texts(spark, "lead\n== A ==\nx\n=== B ===\ny"))
    assert [tuple(r) for r in got.orderBy("sec_num").select("sec_num", "sec_name", "sec_text").collect()] == [
        (0, None, "lead\n"), (1, "== A ==", "x\n"), (2, "=== B ===", "y"),
    ]


SIGNED = "Hi [[User:Ann|Ann]] 10:05, 1 January 2024 (UTC)\n:: yes [[User:Bob]]\ntail"


def test_utterances_and_unsigned_tail(spark):
    got = talk.talk_utterances(talk.talk_sections(_texts(spark, SIGNED)))
    assert [tuple(r) for r in got.orderBy("utt_ind").select("text", "user", "date", "indent_depth", "utt_id").collect()] == [
        ("Hi ", "User:Ann", "10:05, 1 January 2024", 0, "70.0"),
        (":: yes ", "[[User:Bob]]", "unknown", 2, "70.1"),
    ]


def test_unsigned_section_and_two_links(spark):
    got = talk.talk_utterances(talk.talk_sections(_texts(spark, "plain", "a [[User:X|x]] and [[User:Y|y]]\n")))
    assert [tuple(r) for r in got.orderBy("revision_id").select("text", "user", "date").collect()] == [
        ("plain", "unknown", "unknown"), ("a ", "User:X", "unknown"),
    ]


PATTERN = re.compile(r"(\[\[User:.+\]\])(.*\(UTC\))?(?:$|\n)")


@pytest.mark.parametrize("text", [SIGNED, "", "\n", "x [[User:A]]", "x [[User:A]]\n\n y", "a\r\n[[User:B|b]] t (UTC)\r\nc", "[[User:A]] (UTC) z (UTC)\nq"])
def test_signature_split_like_re(spark, text):
    got = talk.talk_utterances(talk.talk_sections(_texts(spark, text))).filter("sec_num = 0").orderBy("utt_ind").collect()
    pieces = PATTERN.split(text)
    expected = [t.lstrip() for t in pieces[:-1][::3]] if len(pieces) > 1 else [text.lstrip()]
    assert [r.text for r in got] == expected


def test_character_references_equal_the_standard_library(spark):
    texts = [
        "it&#8217;s &mdash; caf&eacute;&nbsp;&#x1F600;&#X41;", "&amp;lt; &amp;amp; &#146;&#129; &#0;&#xD800;&#1114112;", "a & b &bogus; &; &#; &#x; ;&&lt;",
        "&NotEqualTilde;&CounterClockwiseContourIntegral;", "plain", "", "&lt;" * 500, "&#38;gt;",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = dict(rows(frame.select("i", W.html_to_text(F.col("t")).alias("t")), "i", "t"))
    assert got == {**{i: unescape(t) for i, t in enumerate(texts)}, len(texts): None}


def test_html_to_text(spark):
    page = "<html><head><style>p{}</style><script>var a='<p>';</script></head><!-- c --><p>a &amp;lt; b&nbsp;&lt;c&gt;</p></html>"
    frame = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert talk.html_to_text(frame).first().text == "a &lt; b <c>"


def test_marker_counts(spark):
    text = "Please, please help. Thanks; could you... by the way: I think we do, i"
    frame = spark.createDataFrame([(text,), ("Why? ",), ("",)], "text string")
    got = talk.marker_counts(frame, lexicon=[*M.LEXICON, *M.word_table(["help"], ["bad"])]).collect()
    first = got[0].asDict()
    assert (first["please"], first["please_start"], first["gratitude"], first["subjunctive"]) == (1, 1, 1, 1)
    assert (first["indirect_btw"], first["hedges"], first["first_person"], first["first_person_plural"]) == (1, 1, 2, 1)
    assert (first["positive"], first["negative"]) == (1, 0)
    assert got[1].direct_question == 1 and sum(got[2][1:]) == 0


@pytest.mark.parametrize("limit", [0, 500_000])
def test_phrase_table_counts_like_the_patterns(spark, limit):
    own = [
        M.Marker("overlap", ("a b", "b", "a b c", "b a"), "any"), M.Marker("long", ("a b c", "a b", "a"), "inner"),
        M.Marker("led", ("a b", "c"), "start"), *M.word_table([f"p{i}" for i in range(5000)], [f"n{i}" for i in range(5000)]),
    ]
    lexicon = [*M.LEXICON, *own]
    dice = random.Random(5)
    stock = ["a", "b", "c", "p7", "N4999", "by", "the", "way", "Please", "could", "you", "in", "fact", "é", "x"]
    texts = ["", None, "...", "a b c a b", "p5000 n5000", "by the way " * 3, "A" + " b" * 4000, *[
        dice.choice(["", "(", "- "]) + dice.choice([" ", ", ", "!? "]).join(dice.choices(stock, k=dice.randint(1, 30))) for _ in range(200)
    ]]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    phrases = spark.createDataFrame([*M.phrase_rows(lexicon), ("led", "C", "start", 9), ("led", "?!", "start", 10)], "strategy string, phrase string, position string, rank int")
    counts = talk.phrase_counts(frame, ["i"], phrases, max_broadcast=limit)
    names = [m.strategy for m in lexicon]
    got = rows(talk.phrase_columns(frame, ["i"], counts, names), "i", *names)
    plain = talk.marker_counts(frame.fillna(""), lexicon=[m for m in lexicon if len(m.words) < 100])
    expected = {r.i: r.asDict() for r in plain.collect()}
    for i, *found in got:
        words = re.findall(r"\w+", (texts[i] or "").lower())
        lists = {"positive": sum(w[0] == "p" and w[1:].isdigit() and int(w[1:]) < 5000 for w in words),
                 "negative": sum(w[0] == "n" and w[1:].isdigit() and int(w[1:]) < 5000 for w in words)}
        assert dict(zip(names, found)) == {n: (expected[i] | lists)[n] for n in names}
    assert len(got) == len(texts) and sum(sum(r[1:]) for r in got) > 500


def test_phrase_table_without_phrases_or_texts(spark):
    frame = spark.createDataFrame([(1, "hi")], "i int, text string")
    phrases = spark.createDataFrame([], "strategy string, phrase string, position string, rank int")
    assert rows(talk.phrase_columns(frame, ["i"], talk.phrase_counts(frame, ["i"], phrases), ["s"]), "i", "s") == [(1, 0)]
    some = spark.createDataFrame([("s", "hi", "any", 0)], phrases.schema)
    assert talk.phrase_counts(frame.limit(0), ["i"], some).count() == 0


def test_words_are_not_matched_inside_words(spark):
    frame = spark.createDataFrame([("éi hithere thankséé",)], "text string")
    assert sum(talk.marker_counts(frame).first()[1:]) == 0


def test_time_stamps_are_parsed(spark):
    rows_ = talk.utterance_details(talk.talk_utterances(talk.talk_sections(_texts(spark, SIGNED)))).orderBy("utt_ind").collect()
    assert str(rows_[0].time) == "2024-01-01 10:05:00" and rows_[1].time is None


def test_flagged_history_per_template(spark):
    history = spark.createDataFrame([(1, "A", 10), (1, "A", 11), (2, "B", 12)], "page_id long, page_title string, revision_id long")
    tagged = spark.createDataFrame(
        [("A", 10, "advert"), ("A", 11, "weasel"), ("A", 10, "advert")], "page_title string, revision_id long, template string"
    )
    got = templates.flag_has_template(history, tagged)
    assert rows(got, "template", "revision_id", "has_template") == [
        ("advert", 10, 1), ("advert", 11, 0), ("weasel", 10, 0), ("weasel", 11, 1),
    ]
