import pytest

from termforge.functions.stemming import porter2, russian, stem


@pytest.mark.parametrize(
    "word, expected",
    [
        ("logging", "log"), ("compaction", "compact"), ("writes", "write"), ("writing", "write"), ("amplification", "amplif"), ("memory", "memori"), ("garbage", "garbag"),
        ("efficient", "effici"), ("roaring", "roar"), ("bitmaps", "bitmap"), ("doing", "do"), ("having", "have"), ("b-tree", "b-tree"), ("skies", "sky"), ("dying", "die"), ("generate", "generat"),
        ("consistency", "consist"), ("knightly", "knight"), ("happy", "happi"), ("cry", "cri"), ("by", "by"), ("say", "say"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"),
        ("nationally", "nation"), ("relational", "relat"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controlling", "control"), ("rolled", "roll"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"),
    ],
)
def test_english(word, expected):
    assert porter2(word) == expected


@pytest.mark.parametrize("word, expected", [("книги", "книг"), ("книга", "книг"), ("важный", "важн"), ("важность", "важност"), ("читать", "чита"), ("красивая", "красив"), ("в", "в")])
def test_russian(word, expected):
    assert russian(word) == expected


def test_other_languages_stay():
    assert stem("logging", "none") == "logging"


def test_endings_found_by_length_are_the_longest():
    from termforge.functions import stemming as s

    for suffixes in (s._STEP1B, s._STEP2, s._STEP3, s._STEP4):
        assert max(map(len, suffixes)) <= 7
        for a in suffixes:
            for word in (a, "x" + a, "tion" + a, a + "x", ""):
                assert s._ending(word, suffixes) == s._longest(word, suffixes)
