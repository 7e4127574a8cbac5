import pytest
from pyspark.sql import functions as F

from regolith.functions import names as N


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("name", "ctx", "subject"),
    [("foo", ".", "foo"), (":.ctx:foo", ".ctx", "foo"), (":.:foo", ".", "foo"), (":.ctx:", ".ctx", ""), (":.ctx", ".ctx", ""), (":*:", "*", ""), (":*:a:b", "*", "a:b"), (":abc:x", ".", ":abc:x"), ("", ".", ""), (":.c:a:b", ".c", "a:b"), ("a\nb", ".", "a\nb"), (":.c:a\nb", ".c", "a\nb")],
)
def test_names(spark, name, ctx, subject):
    assert one(spark, name, N.context_of) == ctx and one(spark, name, N.subject_of) == subject
    if ctx != "*" and not name.startswith(":.:") and subject:
        assert spark.range(1).select(N.qualified(F.lit(ctx), F.lit(subject)).alias("y")).first().y == name


@pytest.mark.parametrize(("spec", "number"), [("latest", -1), (" LaTeSt ", -1), ("-1", -1), ("1", 1), ("+7", 7), ("0", None), ("-2", None), ("x", None), ("2147483648", None), ("", None)])
def test_versions(spark, spec, number):
    assert one(spark, spec, N.version_number) == number


@pytest.mark.parametrize(("ctx", "name"), [("", "."), (".", "."), ("a", ".a"), (".a-b_c.1", ".a-b_c.1"), ("*", "*"), ("a b", None), ("." + "x" * 300, None)])
def test_contexts(spark, ctx, name):
    assert one(spark, ctx, N.normalized_context) == name


def test_subjects(spark):
    assert not one(spark, "tab\there", N.valid_subject) and not one(spark, ":.c:__GLOBAL", N.valid_subject) and one(spark, "", N.valid_subject)


@pytest.mark.parametrize(("text", "pattern", "hit"), [("abc", "a*", True), ("abc", "?b?", True), ("abc", "[!b]bc", True), ("abc", "a", False), ("a.c", "a.c", True), ("abc", "a.c", False), ("a+b", "a+b", True), ("", "*", True)])
def test_globs(spark, text, pattern, hit):
    assert spark.range(1).select(N.glob_match(F.lit(text), F.lit(pattern)).alias("y")).first().y == hit


@pytest.mark.parametrize(("limit", "effective"), [(-1, 100), (0, 100), (2, 2), (5000, 100)])
def test_limits(spark, limit, effective):
    assert one(spark, limit, lambda c: N.effective_limit(c, 100, 1000), "int") == effective


def test_paths(spark):
    assert one(spark, "a:b c/é", N.percent_encoded) == "a:b%20c%2F%C3%A9"
    assert one(spark, "a%3Ab+c", N.percent_decoded) == "a:b c"
    assert one(spark, 40401, N.http_status, "int") == 404


@pytest.mark.parametrize(
    ("path", "shape"),
    [
        ("/subjects/foo/versions/3", "/subjects/*/versions/*"), ("/subjects/latest/versions/latest", "/subjects/*/versions/*"), ("/subjects/foo/versions/x", "/subjects/foo/versions/x".replace("foo", "*")),
        ("/wp-admin/x.php", "/other"), ("/", "/"), ("", "/"), ("/schemas/ids/17/", "/schemas/ids/*"), ("/mode/:.a:b", "/mode/*"), ("/schemas/" + "y" * 60, "/other"), ('/schemas/"', "/other"), ("/schemas/types", "/schemas/types"), (None, None),
    ],
)
def test_route_shapes(spark, path, shape):
    assert one(spark, path, N.route_shape) == shape


def test_method_labels(spark):
    assert one(spark, "PUT", N.method_label) == "PUT" and one(spark, "WHATEVER", N.method_label) == "other"


@pytest.mark.parametrize(
    ("text", "pattern", "hit"),
    [("axb", "a?b", False), ("a?b", "a?b", True), ("[x]1", "[x]*", True), ("x1", "[x]*", False), ("abab", "a*b", False), ("ab", "a*b", True), ("anything", "*", True), ("", "*", True), ("a.b", "a.b", True), ("acb", "a.b", False), ("xerrory", "*error*", True), ("ab", "a", False), ("a\nb", "a*b", True), ("ab\n", "ab", False)],
)
def test_only_stars_are_special_in_authorization(spark, text, pattern, hit):
    assert spark.range(1).select(N.star_match(F.lit(text), F.lit(pattern)).alias("y")).first().y == hit
