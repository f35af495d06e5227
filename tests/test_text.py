from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import html
from lectern.functions import text as T


def values(spark, expression, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_normalize(spark):
    given = [(None,), (" a  b\u0085c ",), ("a\x1cb",), ("é",), ("a‌b​",), ("a\x0bb　c",)]
    assert values(spark, T.normalize("x"), given) == ["", "a b c", "a b", "é", "a‌b​", "a b c"]


def test_normalize_is_idempotent_and_like_str_split(spark):
    import unicodedata

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab \t\n  éక‌") for _ in range(12)) for _ in range(200)]
    got = values(spark, T.normalize("x"), [(t,) for t in texts])
    assert got == [unicodedata.normalize("NFC", " ".join(t.split())) for t in texts]
    assert values(spark, T.normalize("x"), [(t,) for t in got]) == got


def test_label_keeps_inner_space(spark):
    assert values(spark, T.normalized_label("x"), [("  a  b　",), (None,)]) == ["a  b", ""]


def plain_clean(text):
    letter = lambda c: "ఀ" <= c <= "౿"
    kept = []
    for k, c in enumerate(text):
        hyphen = c == "-" and 0 < k < len(text) - 1 and letter(text[k - 1]) and letter(text[k + 1])
        kept.append(c if letter(c) or c in "‌‍ " or hyphen else " ")
    return " ".join("".join(kept).split())


def test_clean_script(spark):
    fixed = {"abo) DE": "", "క-ఖ": "క-ఖ", "a-క": "క", "క-ఖ-గ": "క-ఖ-గ"}
    assert values(spark, T.clean_script("x"), [(k,) for k in fixed]) == list(fixed.values())
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("కఖ--ab ‌") for _ in range(9)).split()) for _ in range(300)]
    assert values(spark, T.clean_script("x"), [(t,) for t in texts]) == [plain_clean(t) for t in texts]


def test_script_flags(spark):
    rows = spark.createDataFrame([("abo) DE",), ("క",), ("కఖ",), ("‌",)], "x string").select(T.script_flags("x").alias("f"), T.output_status("f.text").alias("s")).select("f.*", "s").collect()
    assert [(r["suspicious_reason"], r["character_count"], r["suspicious_output"], r["s"]) for r in rows] == [
        ("no_telugu_text", 0, True, "empty_output"),
        ("fewer_than_2_telugu_characters", 1, True, "ok"),
        ("", 2, False, "ok"),
        ("no_telugu_text", 0, True, "ok"),
    ]


def test_image_keys(spark):
    paths = ["test/9/13/1.png", "/x/sample_set/val/4/69/2.after.png", "/a/b/c/d/e.png", "a/b/c.png", "/a/b/c.png", "/p/processed_sample_set/val/4/69/2.png", None]
    strict = values(spark, T.image_key_strict("x"), [(p,) for p in paths])
    lenient = values(spark, T.image_key_lenient("x"), [(p,) for p in paths])
    as_tuple = lambda r: r and tuple(r)
    assert [as_tuple(r) for r in strict] == [("test", "9", "13", "1"), ("val", "4", "69", "2.after"), None, None, ("", "a", "b", "c"), ("val", "4", "69", "2"), None]
    assert [as_tuple(r) for r in lenient] == [("test", "9", "13", "1"), ("val", "4", "69", "2.after"), ("b", "c", "d", "e"), None, ("", "a", "b", "c"), ("val", "4", "69", "2"), None]


def test_natural_order(spark):
    key = lambda s: [int(p) if p.isdigit() else p.lower() for p in re.split(r"(\d+)", s)]
    rng = random.Random(3)
    names = ["src2", "src10", "p_1_2", "p_1_10", "SRC3", *{"".join(rng.choice("ab_01239") for _ in range(6)) for _ in range(200)}]
    ordered = [r[0] for r in spark.createDataFrame([(n,) for n in names], "x string").orderBy(T.natural_key("x"), "x").collect()]
    assert ordered == sorted(names, key=lambda n: (key(n), n))


def test_image_order(spark):
    rows = [(x,) for x in ("10_2", "1", "odd", "10", "2")]
    assert [r[0] for r in spark.createDataFrame(rows, "x string").orderBy(T.image_order("x"), "x").collect()] == ["1", "2", "10", "10_2", "odd"]


def test_names_and_configurations(spark):
    assert values(spark, T.safe_name("x"), [("a b/c",), ("//",), ("_x_",)]) == ["a_b_c", "model", "x"]
    fields = values(spark, T.config_fields("x"), [("s/raw/results.jsonl",), ("results.jsonl",), ("s/p/r2/results.jsonl",)])
    assert [tuple(f) for f in fields] == [("s/raw", "s", "raw", "raw"), ("", "unknown", "unknown", "unknown"), ("s/p/r2", "s", "p", "r2")]


def test_numbers_and_reasons(spark):
    assert values(spark, T.format_number("x"), [(1.005,), (None,)], "x double")[1] == "N/A"
    assert values(spark, F.bround(F.col("x"), 6), [(0.0078125,)], "x double") == [0.007812]
    assert values(spark, T.reasons((F.lit(True), "b"), (F.lit(False), "a"), (F.lit(True), "b")), [("",)]) == ["b"]


def test_html(spark):
    given = ["<h2>a</h2><h2>b</h2>", "a<br>b", "&amp;", "<script>x</script>y", "<p>a &lt;b&gt;</p><li>c", None]
    assert values(spark, html.html_to_text("x"), [(g,) for g in given]) == ["ab", "a b", "&", "xy", "a <b> c", ""]
    assert values(spark, html.html_to_text_fast("x"), [(g,) for g in given]) == ["ab", "a b", "&", "y", "a <b> c", ""]


@pytest.mark.parametrize("suffix", [".txt", ".json"])
def test_output_path(spark, suffix):
    assert values(spark, T.output_path("x", "text", suffix), [("a/b/1.png",)]) == [f"text/a/b/1{suffix}"]


def test_text_of_html_by_either_way(spark):
    import html as entities
    import re

    from lectern.functions import html as H

    def by_hand(page):
        """Tags and comments taken out one by one; script and style contents stay as they are."""
        out, raw = [], None
        for token in re.split(r"(<!--.*?-->|<!\w[^>]*>|</?[A-Za-z][^>\s/]*(?:\s+[^>\s=]+(?:=(?:\"[^\"]*\"|'[^']*'|[^\s>]*))?)*\s*/?>)", page, flags=re.S):
            name = re.match(r"</?([A-Za-z][^>\s/]*)", token)
            if name and (not raw or token.lower().startswith("</" + raw)):
                tag = name[1].lower()
                raw = tag if tag in ("script", "style") and token[1] != "/" else None
                out.append(" " if tag in H.BREAKS else "")
            elif not token.startswith("<!") or raw:
                out.append(token if raw else entities.unescape(token))
        return " ".join("".join(out).split())

    made = ["", "a < b", "<p>a&eacute;b&#39;c</p><script>var x</script><b>z</b>", "<P>One<br/>two</P><LI>x", "<b>bo</b>ld", '<a title="x > y">q</a>', "<!-- no --><i>yes</i>", "x &amp; y &lt;z&gt;", "<style>p < q & r</style>s", "<td>1</td><td>2</td>"]
    pages = made + [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, h string")
    got = {r["k"]: r for r in frame.select("k", H.html_to_text("h").alias("one"), H.response_text(F.array(F.struct(F.lit(False).alias("skipped"), F.lit(False).alias("error"), F.lit(1).alias("reading_order"), F.col("h").alias("html")))).alias("block")).collect()}
    for k, page in enumerate(pages):
        assert got[k]["one"] == by_hand(page) == got[k]["block"]


def test_numbers_of_any_length_sort(spark):
    names = ["a9", "a10", "a0010b", "a" + "9" * 45, "a1" + "0" * 45, "a2" + "0" * 44, "b1", "10", "9"]
    rows = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r["x"] for r in rows.orderBy(T.natural_key("x"), "x").collect()]
    plain = lambda x: [(int(p) if p.isdigit() else 0, "" if p.isdigit() else p) for p in re.findall(r"\d+|\D+", x)]
    want = sorted(names, key=lambda x: [(s, n) for n, s in plain(x)])
    assert got[-1] == "b1" and got[:2] == ["9", "10"]
    assert [x for x in got if x[0] == "a"] == [x for x in want if x[0] == "a"]
