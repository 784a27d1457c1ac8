import pytest

from fernpath.functions import literals, paths, regexes
from fernpath.functions.regexes import ANYTHING, All, Any, java, needed


@pytest.mark.parametrize(
    "text, value, op",
    [("36MB+", 36_000_000, "ge"), ("9KB-", 9000, "le"), ("81GB", 81_000_000_000, "eq"), ("4gb+", 4_000_000_000, "ge"), (" 12 kb ", 12_000, "eq"), ("7", 7, "eq"), ("0B-", 0, "le")],
)
def test_size(text, value, op):
    assert literals.size(text) == literals.Bound(value, op)


@pytest.mark.parametrize("text, value, op", [("11d-", 950_400, "ge"), ("3w+", 1_814_400, "le"), ("45m", 2700, "eq"), ("-6h", -21_600, "eq")])
def test_age(text, value, op):
    assert literals.age(text) == literals.Bound(value, op)


@pytest.mark.parametrize("read, text", [(literals.size, t) for t in ("many", " ", "2.5GB", "8TB", "3K", "++1")] + [(literals.age, t) for t in (" ", "12", "9s", "4 w", "2H")] + [(literals.mime, t) for t in ("audio", " ", "*/*")])
def test_bad_literals(read, text):
    with pytest.raises(literals.LiteralError):
        read(text)


def test_mime():
    assert literals.mime("audio/ogg") == literals.Mime("audio/ogg", False)
    assert literals.mime("image/p*g") == literals.Mime("image/pg", True)


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", "a*+", "(?>a)", "a\\"])
def test_outside_the_dialect(pattern):
    with pytest.raises(regexes.RegexError):
        java(pattern)


def test_java_form():
    assert java(r"\.lua$") == r"(?dU)\.lua\z"
    assert java(r"[$]\$", True) == r"(?diuU)[$]\$"
    assert java("[[:digit:]x]+") == "(?dU)[[0-9]x]+" and java("[^[:^upper:]]") == "(?dU)[^[^A-Z]]"
    assert java("(?m)a$") == "(?dU)(?m)a$" and java("(?m:a$)b$") == "(?dU)(?m:a$)b\\z" and java("(?m)(?-m:a$)$") == "(?dU)(?m)(?-m:a\\z)$" and java("((?m)a$)b$") == "(?dU)((?m)a$)b\\z"


def test_dialect_in_the_engine(spark):
    rows = spark.createDataFrame([("/a/77x",), ("/a/dgt",), ("one\ntwo",), ("/A/ä",)], "p string")
    hit = lambda p: [r.p for r in rows.where(rows.p.rlike(regexes.checked(spark, p))).collect()]
    assert hit("/[[:digit:]]+x$") == ["/a/77x"] and hit("[[:^ascii:]]") == ["/A/ä"] and hit("^/[[:upper:]]/") == ["/A/ä"]
    assert hit("one$") == [] and hit("(?m)one$") == hit("(?m)^two") == ["one\ntwo"]


def test_needed():
    assert needed("oak|elm") == Any((All(("oak",)), All(("elm",))))
    assert needed(r"\bash") == All(("ash",))
    assert needed("grey?ish") == All(("gre", "ish"))
    assert needed("p(qr)+s") == All(("p", "qr", "s"))
    assert needed("[a-f]+") == needed("z*") == needed("(?m)elm") == needed("[[:digit:]]") == ANYTHING
    assert needed(r"a\.b") == All(("a.b",))


def test_grams(spark):
    from pyspark.sql import functions as F

    def grams(text, n, fold=False):
        return spark.createDataFrame([(paths.fold(text) if fold else text,)], "t string").select(paths.grams(F.col("t"), n)).first()[0]

    assert grams("willow", 3) == ["ill", "llo", "low", "wil"]
    assert grams("xy", 3) == ["_xy"] and grams("x", 3) == ["_x_"] and grams("", 3) == ["___"]
    assert grams("-zzzz", 3) == ["-zz", "zzz"]
    assert grams("Elm.TXT", 3, True) == [".tx", "elm", "lm.", "m.t", "txt"]
    assert grams("ivy.go", 2) == [".g", "go", "iv", "vy", "y."] and grams("v", 2) == []


def test_path_parts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("/q/.vimrc",), ("/q/elm.tar.xz",), ("/q/r/",), ("bare",), ("/q/elm.",)], "p string")
    found = [tuple(r) for r in rows.select(paths.extension(F.col("p")), paths.basename(F.col("p"))).collect()]
    assert found == [("", ".vimrc"), ("xz", "elm.tar.xz"), ("", ""), ("", "bare"), ("", "elm.")]


def test_sizes_round_half_to_even(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1023,), (1280,), (1 << 20,), (5 << 30,)], "s long")
    assert [r[0] for r in rows.select(paths.human_size(F.col("s"))).collect()] == ["1023 B", "1.2 KB", "1.0 MB", "5.0 GB"]
