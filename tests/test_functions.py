import pytest
from pyspark.sql import functions as F

from tablemend.functions import loglik
from tablemend.functions.editdist import edit_distance
from tablemend.functions.expr import approx_equal, blocking_key, is_abbreviation, is_time, ln_gamma, safe_ln
from tablemend.functions.units import IDENTITY, THOUSANDS, best_unit
from tablemend.operators.choose import log_add


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def S(x):
    return F.lit(x)


def D(x):
    return F.lit(float(x))


def nothing():
    return F.lit(None).cast("string")


CASES = [
    ("typo none", lambda: loglik.typos(S(0), S("boston"), S("boston")), -0.210721),
    ("typo one", lambda: loglik.typos(S(1), S("bostn"), S("boston")), -5.240967),
    ("typo one bounded", lambda: loglik.typos(S(1), S("bostn"), S("boston"), 2), -5.240967),
    ("typo missing", lambda: loglik.typos(S(0), nothing(), S("boston")), 0.0),
    ("typo too many", lambda: loglik.typos(S(3), S("bsn"), S("boston"), 2), -100000.0),
    ("typo empty word", lambda: loglik.typos(S(1), S("a"), S("")), -100000.0),
    ("swap equal", lambda: loglik.swap(S("a"), S("a"), S(4), D(0.1)), -0.105361),
    ("swap different", lambda: loglik.swap(S("b"), S("a"), S(4), D(0.1)), -3.688879),
    ("swap missing in", lambda: loglik.swap(nothing(), S("a"), S(4), D(0.1), S(True)), 0.0),
    ("swap missing out", lambda: loglik.swap(nothing(), S("a"), S(4), D(0.1), S(False)), -1000.0),
    ("uniform", lambda: loglik.uniform_choice(S(4)), -1.386294),
    ("time", lambda: loglik.time_of_day(S("7:05 a.m.")), -7.272398),
    ("number", lambda: loglik.number_code(S(1000)), -6.907755),
    ("number zero", lambda: loglik.number_code(S(0)), -1e9),
    ("gaussian", lambda: loglik.gaussian(D(1600), D(1500), D(150)), -6.151796),
    ("unit thousands", lambda: loglik.gaussian_in_unit(D(1.6), D(1500), D(150), THOUSANDS), 0.755959),
    ("unit identity", lambda: loglik.gaussian_in_unit(D(1.6), D(1500), D(150), IDENTITY), -55.822964),
    ("name full", lambda: loglik.full_name(S("Ann b COLE"), S("ann"), S("b"), S("cole")), -0.316082),
    ("name short", lambda: loglik.full_name(S("ann cole"), S("ann"), S("b"), S("cole")), -2.302585),
    ("name other", lambda: loglik.full_name(S("bob"), S("ann"), S("b"), S("cole")), -1000.0),
    ("one name equal", lambda: loglik.one_name(S("Ann"), S("ann")), -0.000100),
    ("one name initial", lambda: loglik.one_name(S("a."), S("Ann")), -9.210340),
    ("one name missing", lambda: loglik.one_name(nothing(), S("Ann")), -5.0),
    ("one name missing star", lambda: loglik.one_name(nothing(), S("**")), -1000.0),
    ("one name missing empty", lambda: loglik.one_name(nothing(), S("")), 0.0),
    ("link existing", lambda: loglik.link_existing(S(3), S(10), D(1), D(0.25)), -1.386294),
    ("link new", lambda: loglik.link_new(S(4), S(10), D(1), D(0.25)), -1.704748),
    ("log add", lambda: log_add(D(-1), D(-2)), -0.686738),
    ("ln gamma", lambda: ln_gamma(D(3.5)), 1.200974),
    ("ln gamma large", lambda: ln_gamma(D(1e6)), 12815504.569148),
    ("safe ln", lambda: safe_ln(D(0)), -1e9),
]


@pytest.mark.parametrize("name,expr,expected", CASES, ids=[c[0] for c in CASES])
def test_hand_checked(spark, name, expr, expected):
    assert value(spark, expr()) == pytest.approx(expected, abs=1e-6, rel=1e-9)


def test_predicates(spark):
    assert value(spark, is_abbreviation(S("NYC"), S("new york city")))
    assert not value(spark, is_abbreviation(S("yn"), S("new york")) & is_abbreviation(S("zz"), S("new york")))
    assert value(spark, is_time(S("12:05 p.m."))) and not value(spark, is_time(S("12.05 pm")))
    assert value(spark, approx_equal(D(1.0), D(1.0 + 1e-9))) and not value(spark, approx_equal(D(1.0), D(1.001)))
    assert value(spark, approx_equal(F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert value(spark, blocking_key(S("Los Angeles County"))) == "Ls"


@pytest.mark.parametrize("a,b,k", [("ca", "abc", 2), ("ab", "ba", 1), ("", "ab", 2), ("abcd", "badc", 2), ("abcd", "abcd", 0), ("abc", "xyz", 3)])
def test_edit_distance(spark, a, b, k):
    assert value(spark, edit_distance(S(a), S(b))) == k
    assert value(spark, edit_distance(S(a), S(b), 2)) == k


def test_best_unit(spark):
    got = value(spark, best_unit(D(1.6), D(1500), D(150), (IDENTITY, THOUSANDS)))
    assert got["unit"] == "thousands" and got["base"] == 1600.0
