"""Stems of words from the published sample vocabulary of the algorithm."""

import random

from pyspark.sql import functions as F

from plain_stems import stem_word
from tripweave.functions.stemming import IRREGULAR, SECOND, THIRD, FOURTH, probe, with_stem

KNOWN = """
consign consign consigned consign consigning consign consignment consign consist consist
consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol
consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort
conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir
conspirators conspir conspire conspir constable constabl constables constabl constance constanc
constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag
knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel
kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew
knick knick knif knif knife knife knight knight knightly knight knights knight knit knit
knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock
knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
skies sky dying die news news generate generat generally general communism communism
museums museum museum museum histories histori history histori foods food happy happi happily happili
ties tie cries cri gas gas this this gaps gap kiwis kiwi hopping hop hoping hope bed bed
luxuriated luxuri controlled control by by say say cry cri agreed agre feed feed national nation
rational ration tower tower towers tower walking walk walks walk outing outing
""".split()



def stems(spark, words):
    frame = spark.createDataFrame([(w, 1) for w in words], "w string, stem int")
    return {r.w: r.out for r in with_stem(frame, "w", "out").collect()}


def test_known_stems(spark):
    assert stems(spark, KNOWN[::2]) == dict(zip(KNOWN[::2], KNOWN[1::2]))


def odd_words():
    random.seed(3)
    ends = [*SECOND, *THIRD, *FOURTH, "eed", "eedly", "ed", "edly", "ing", "ingly", "sses", "ies", "s", "y", "e", "ll", ""]
    made = ["".join(random.choices(["a", "e", "i", "y", "u", "t", "s", "r", "l", "ck", "bl", "gener"], k=random.randint(0, 4)))
            + random.choice(ends) + random.choice(["", "", "s", "ly"]) for _ in range(4000)]
    return sorted({*made, *IRREGULAR, "été", "x1", "yyy", "sayyid", "a", ""})


def test_columns_equal_the_rules_word_by_word(spark):
    words = odd_words()
    assert stems(spark, words) == {w: stem_word(w) for w in words}


def test_every_word_begins_as_its_stem_does(spark):
    frame = spark.createDataFrame([(w,) for w in odd_words()], "w string")
    for r in with_stem(frame, "w", "out").withColumn("p", probe(F.col("out"), 6)).collect():
        assert r.w.startswith(r.p), r


def test_null_words_have_no_stem(spark):
    assert stems(spark, [None, "museums"]) == {None: None, "museums": "museum"}
