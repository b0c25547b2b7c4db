"""Rules on single tokens and messages."""

import random
import re
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from faultscope.functions import text, values
from faultscope.operators import messages as msg


def column_values(spark, inputs, make, kind="string"):
    rows = [(i, v) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


URL_TOKENS = [
    "https://host.org:8443/a/b?x=1#top", "srm://h/p;v=1", "http://h/a;x/b;y", "HTTP://H/P", "https://h", "//h/p",
    "a;b", "what?", "x#y", "mailto:me@x.org", "a:b:c", "1:2", "ftp://h/a;type=i", "news:a;b", "plain", "c++:x",
    "://x", ":", "http:", "http:///p", "http://h?q", "http://h#f", "gsiftp://h//a//b", "file:/a/b", "tel:1;ext=2",
    "[net=x]", "é:x", "a/b;c/d", "a/b;c", ";", "/;x", "urn:a:b#c", "x://y/z://w",
]


def expected_url(token):
    p = urlparse(token)
    if not p.scheme:
        return p.path
    return f"{p.scheme}://{p.netloc} {p.path}" if p.netloc and p.path else f"{p.scheme}:{p.path}"


def test_url_tokens(spark):
    assert column_values(spark, URL_TOKENS, text.url_token) == [expected_url(t) for t in URL_TOKENS]


def test_bare_host_is_kept_on_request(spark):
    got = column_values(spark, ["https://h", "https://h/p"], lambda c: text.url_token(c, keep_bare_host=True))
    assert got == ["https://h", "https://h /p"]


def test_split_urls_handles_all_white_space(spark):
    inputs = ["  a\u00a0b\tc\x1cd ", "", None, "x https://h/p?q  y"]
    assert column_values(spark, inputs, text.split_urls) == ["a b c d", "", "", "x https://h /p y"]


@pytest.mark.parametrize(
    "token, parts",
    [
        ("500-500-system", ["500", "system"]),
        ("+5-x", ["+5", "x"]),
        ("1_0-a", ["1_0", "a"]),
        ("a-b", ["a-b"]),
        ("12", ["12"]),
        ("٣-x", ["٣", "x"]),
        ("1__0-a", ["1__0-a"]),
        ("5-15-5-x", ["5", "1x"]),
    ],
)
def test_split_code_prefix(spark, token, parts):
    assert column_values(spark, [token], text.split_code_prefix) == [parts]


def test_tokenize_steps(spark):
    df = spark.createDataFrame(
        [(1, "The Error: 500-500-Copy, of THE file - https://h/p;x failed."), (2, None)],
        "msg_id int, t__error_message string",
    )
    rows = {r["msg_id"]: r for r in msg.tokenize_messages(df).collect()}
    assert rows[1]["tokens_cleaned"] == ["the", "error", "500", "copy", "of", "the", "file", "", "https://h", "/p", "failed"]
    assert rows[1]["stop_token"] == ["error", "500", "copy", "file", "", "https://h", "/p", "failed"]
    assert rows[1]["stop_token_1"] == ["error", "500", "copy", "file", "https://h", "/p", "failed"]
    assert rows[2]["stop_token_1"] == []


KINDS = {
    "http://x/y": r"\$URL",
    "a:b:c:d": r"\$IPv6",
    "a:b:c:/d": "a:b:c:/d",
    "1.2.3": r"\$ADDRESS",
    "path=x": r"\$PATH",
    "/a/b.root": r"\$FILE_PATH",
    "/a.root": "/a.root",
    "[net=tcp]": r"\$NET_PARAM",
    "(expected=5": r"\$EXPECTED_SIZE",
    "actual=6)": r"\$ACTUAL_SIZE",
    "(/cn=x": r"\$EXPECTED_REMOTE_ENTITY",
    "(/dc=x": r"\$ACTUAL_REMOTE_ENTITY",
    "word": "word",
}


def test_parameter_kinds(spark):
    assert column_values(spark, list(KINDS), text.replace_parameters) == list(KINDS.values())


def test_general_replacement_leaves_other_kinds(spark):
    got = column_values(spark, ["http://x", "/a/b.root"], lambda c: text.replace_parameters(c, "#"))
    assert got == ["#", "/a/b.root"]


def expected_ids(tokens):
    """State machine: one pending word at most."""
    out, pending = [], None
    for token in tokens:
        if pending is None:
            out.append(token)
        elif pending == "message" and not token.startswith("<1:2>"):
            out += [token, r"\$MESSAGE_ID"]
        else:
            out.append(rf"\${pending.upper()}_ID")
        pending = token if token in text.ID_WORDS else None
    return out


def test_ids_follow_the_state_machine(spark):
    words = [*text.ID_WORDS, "x", "<1:2>", "<1:2>;", "<1:a>", "7"]
    rng = random.Random(7)
    lists = [[rng.choice(words) for _ in range(rng.randrange(8))] for _ in range(500)]
    got = column_values(spark, lists, text.replace_ids, "array<string>")
    assert got == [expected_ids(t) for t in lists]


def test_hostname(spark):
    inputs = ["srm://a.b-c:8443/x", "host/p", "", "://", "x://y://z.org/p"]
    found = [re.search(r"^(.*?://)?([\w.-]+).*", v) for v in inputs]
    assert column_values(spark, inputs, text.hostname) == [m.group(2) if m else "" for m in found]


def test_rare_words_keep_white_space_and_case(spark):
    rows = [(1, "Lost  node77\tagain"), (2, "lost node78 again"), (3, "lost abc again"), (4, None), (5, "LOST Node99")]
    masked = msg.mask_rare_words(spark.createDataFrame(rows, "id bigint, t string"), ["t"], "id")
    got = {r["id"]: r["t"] for r in masked.collect()}
    mark = text.RARE_WORD_MASK
    assert got == {1: f"Lost  {mark}\tagain", 2: f"lost {mark} again", 3: "lost abc again", 4: None, 5: "LOST Node99"}


def test_parse_date(spark):
    inputs = ["2024-02-03", "03.02.2024", "03/02/2024", "02-2024", None]
    got = column_values(spark, inputs, values.parse_date)
    assert [None if g is None else (g.year, g.month, g.day) for g in got] == [(2024, 2, 3)] * 3 + [None, None]
    with pytest.raises(Exception, match="no valid date"):
        column_values(spark, ["nonsense"], lambda c: values.parse_date(c, strict=True))


def test_canonical_maps_and_merge(spark):
    a = F.expr("map('x', map('t', 1L, 'u', 2L))")
    b = F.expr("map('y', map('v', 5L), 'x', map('u', 3L))")
    row = spark.range(1).select(
        values.canonical_nested_map(values.merge_counts(a, b)).alias("m"),
        (values.canonical_map(F.expr("map('b', 1, 'a', 2)")) == values.canonical_map(F.expr("map('a', 2, 'b', 1)"))).alias("same"),
    ).first()
    assert row["same"]
    assert row["m"] == '[{"key":"x","value":[{"key":"t","value":1},{"key":"u","value":5}]},{"key":"y","value":[{"key":"v","value":5}]}]'


def test_parts_split_at_the_blanks_of_words_and_nowhere_else(spark):
    blanks = text.OTHER_BLANKS + " "
    texts = [f"a{chr(c)}b" for c in range(0x3100)] + [f"a{c}{d}b" for c in blanks for d in blanks[:3]]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.text_parts(F.col("t")).alias("parts"))
    for t, parts in df.collect():
        inner = t[1:-1]
        assert parts == (["a", inner, "b"] if set(inner) <= set(blanks) else [t])


def test_rare_words_keep_their_places(spark):
    """Twice in one row, in rows with and without id, in rows that share an id, beside frequent words."""
    rows = [(1, " twice here twice\tso"), (2, "often often  Often lonely"), (None, "nobody shared"), (3, "shared Upper"), (4, "double one"), (4, "double two"), (5, None)]
    df = spark.createDataFrame(rows, "id bigint, t string")
    mark = text.RARE_WORD_MASK
    got = sorted((r[0] is None, r[0] or 0, r[1] or "") for r in msg.mask_rare_words(df, ["t"], "id").collect())
    want = [(1, f" {mark} {mark} {mark}\tso"), (2, f"often often  Often {mark}"), (3, f"{mark} Upper"), (4, f"{mark} one"), (4, f"{mark} two"), (5, "")]
    assert got == [(False, i, t) for i, t in want] + [(True, 0, "nobody shared")]
    # Buffers of numbers are added up by hash; a sort per word would come with every other kind.
    plan = msg.mask_rare_words(df, ["t"], "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
