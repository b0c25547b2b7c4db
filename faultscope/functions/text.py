"""Column functions over messages and token arrays.

Everything here is a native expression: no Python runs per row, and a message is never cut.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultscope.functions.stopwords import EMPTY_TOKENS, ENGLISH

# The white space of Unicode, with the four separators U+001C to U+001F.
OTHER_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ASCII_BLANKS = "\t\n\x0b\x0c\r"

# URL schemes whose last path segment may carry ";parameters".
PARAMETER_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
]

# Characters stripped from both ends of a token.
TOKEN_PUNCTUATION = ":;,.- "

# Words whose following token is an identifier.
ID_WORDS = ["transaction", "process", "message", "relation", "database", "tuple"]

RARE_WORD_MASK = "**REPLACEMENT**"
NUMBER_MASK = "((*))"
HOST_PATTERN = r"(?U)^(.*?://)?([\w.-]+).*"


def _blanks_to_spaces(text: Column, blanks: str) -> Column:
    # Splitting at a single blank needs no regular expression.
    return F.split(F.translate(text, blanks, " " * len(blanks)), " ")


def words(text: Column) -> Column:
    """White-space separated words; null and blank text give an empty array."""
    return F.filter(_blanks_to_spaces(F.coalesce(text, F.lit("")), OTHER_BLANKS), lambda w: w != "")


# -- URLs ---------------------------------------------------------------------------------


def _url_parts(token: Column) -> Column:
    """Scheme, net location and path of a token, without query, fragment and parameters."""
    scheme = F.lower(F.regexp_extract(token, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(token, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    return F.struct(
        scheme.alias("scheme"),
        F.regexp_extract(rest, r"^//([^/?#]*)", 1).alias("host"),
        F.regexp_extract(rest, r"^(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
    )


def _drop_parameters(url: Column) -> Column:
    path = F.when(
        url["scheme"].isin(PARAMETER_SCHEMES),
        F.regexp_replace(url["path"], r"^((?:.*/)?[^/;]*);[^/]*$", "$1"),
    ).otherwise(url["path"])
    return F.struct(url["scheme"].alias("scheme"), url["host"].alias("host"), path.alias("path"))


def _url_text(url: Column, keep_bare_host: bool) -> Column:
    scheme, host, path = url["scheme"], url["host"], url["path"]
    text = F.when(scheme == "", path).when(
        (host != "") & (path != ""), F.concat(scheme, F.lit("://"), host, F.lit(" "), path)
    )
    if keep_bare_host:
        text = text.when(host != "", F.concat(scheme, F.lit("://"), host))
    return text.otherwise(F.concat(scheme, F.lit(":"), path))


def _rewrite_urls(tokens: Column, keep_bare_host: bool) -> Column:
    # One array pass per step, so that no regular expression is evaluated twice; tokens
    # without any URL character skip them all.
    def parts(token: Column) -> Column:
        plain = F.struct(
            F.lit("").alias("scheme"), F.lit("").alias("host"), token.alias("path")
        )
        return F.when(token.rlike(r"[:;?#]|^//"), _drop_parameters(_url_parts(token))).otherwise(
            plain
        )

    return F.transform(F.transform(tokens, parts), lambda u: _url_text(u, keep_bare_host))


def url_token(token: Column, keep_bare_host: bool = False) -> Column:
    """``scheme://host path`` for a URL, ``scheme:path`` without host, else the bare path.

    A URL with a host and no path keeps only ``scheme:`` unless ``keep_bare_host`` is set.
    """
    return F.element_at(_rewrite_urls(F.array(token), keep_bare_host), 1)


def split_urls(message: Column, keep_bare_host: bool = False) -> Column:
    """The message with each URL separated into host and path, words one blank apart."""
    return F.array_join(_rewrite_urls(words(message), keep_bare_host), " ")


# -- tokens -------------------------------------------------------------------------------


def lower_tokens(text: Column) -> Column:
    """The lower-case text split at every blank."""
    return _blanks_to_spaces(F.lower(text), ASCII_BLANKS)


def split_code_prefix(token: Column) -> Column:
    """``500-500-system`` gives ``[500, system]``: the number leading up to the first dash, then
    the token without any ``number-``. Other tokens give an array of themselves."""
    number = F.regexp_extract(token, r"(?U)^(\+?\d+(?:_\d+)*)-", 1)
    split = F.array(number, F.replace(token, F.concat(number, F.lit("-")), F.lit("")))
    # Most tokens have no dash and never get to the expression.
    return F.when(F.contains(token, F.lit("-")) & (number != ""), split).otherwise(F.array(token))


def clean_tokens(tokens: Column, split_codes: bool = True) -> Column:
    """Drop empty tokens, strip punctuation from both ends, optionally split number prefixes."""
    stripped = F.transform(
        F.filter(tokens, lambda t: t != ""), lambda t: F.btrim(t, F.lit(TOKEN_PUNCTUATION))
    )
    return F.flatten(F.transform(stripped, split_code_prefix)) if split_codes else stripped


def remove_words(tokens: Column, stop_words: list[str]) -> Column:
    """Tokens that are not in the list, whatever their case; repeated tokens stay repeated."""
    listed = [w.lower() for w in stop_words]
    return F.filter(tokens, lambda t: ~F.lower(t).isin(listed))


def remove_english(tokens: Column) -> Column:
    return remove_words(tokens, ENGLISH)


def remove_empty(tokens: Column) -> Column:
    return remove_words(tokens, EMPTY_TOKENS)


def detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


# -- abstraction --------------------------------------------------------------------------


def _count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def is_url(token: Column) -> Column:
    return F.contains(token, F.lit("://"))


def is_ipv6(token: Column) -> Column:
    return (_count_char(token, ":") >= 3) & ~F.contains(token, F.lit("/"))


def is_address(token: Column) -> Column:
    return (_count_char(token, ".") >= 2) & ~F.contains(token, F.lit("/"))


def is_path(token: Column) -> Column:
    return F.startswith(token, F.lit("path="))


def is_file_path(token: Column) -> Column:
    rest = F.substring(token, 2, 2**31 - 1)
    return (
        F.startswith(token, F.lit("/"))
        & F.contains(rest, F.lit("."))
        & F.contains(rest, F.lit("/"))
    )


def is_net_param(token: Column) -> Column:
    return F.startswith(token, F.lit("[net="))


# The placeholder of each kind of parameter, first match wins; the backslash is
# part of the placeholder.
GENERAL_PARAMETERS = [
    (is_url, r"\$URL"),
    (is_ipv6, r"\$IPv6"),
    (is_address, r"\$ADDRESS"),
    (is_path, r"\$PATH"),
]
SPECIAL_PARAMETERS = [
    (is_file_path, r"\$FILE_PATH"),
    (is_net_param, r"\$NET_PARAM"),
]
PREFIX_PARAMETERS = [
    ("(expected=", r"\$EXPECTED_SIZE"),
    ("actual=", r"\$ACTUAL_SIZE"),
    ("(/cn=", r"\$EXPECTED_REMOTE_ENTITY"),
    ("(/dc=", r"\$ACTUAL_REMOTE_ENTITY"),
]


def replace_parameters(token: Column, replacement: str | None = None) -> Column:
    """The placeholder of the token's kind, or the token itself.

    With ``replacement``, only URLs, IPv6 and dotted addresses and ``path=`` are replaced, all
    by that text.
    """
    rules = [(test(token), text) for test, text in GENERAL_PARAMETERS]
    if replacement:
        rules = [(test, replacement) for test, _ in rules]
    else:
        rules += [(test(token), text) for test, text in SPECIAL_PARAMETERS]
        rules += [(F.startswith(token, F.lit(p)), text) for p, text in PREFIX_PARAMETERS]
    chain = F.when(rules[0][0], F.lit(rules[0][1]))
    for test, text in rules[1:]:
        chain = chain.when(test, F.lit(text))
    return chain.otherwise(token)


def replace_ids(
    tokens: Column, id_words: list[str] | None = None, strict_message_id: bool = False
) -> Column:
    """Replace the token after each id word by ``\\$<WORD>_ID``.

    After ``message`` only a ``<n:n>`` prefix counts as the id; any other token is kept *and*
    followed by the placeholder, unless ``strict_message_id`` leaves out the placeholder.
    """
    listed = ID_WORDS if id_words is None else id_words

    def emit(token: Column, index: Column) -> Column:
        previous = F.get(tokens, index - 1)
        placeholder = F.concat(F.lit(r"\$"), F.upper(previous), F.lit("_ID"))
        no_id = (previous == "message") & ~token.rlike(r"^<[0-9]+:[0-9]+>")
        kept = F.array(token) if strict_message_id else F.array(token, placeholder)
        return (
            F.when(~F.coalesce(previous.isin(listed), F.lit(False)), F.array(token))
            .when(no_id, kept)
            .otherwise(F.array(placeholder))
        )

    return F.flatten(F.transform(tokens, emit))


def replace_token_parameters(tokens: Column, replacement: str | None = None) -> Column:
    return F.transform(tokens, lambda t: replace_parameters(t, replacement))


# -- hosts, hashes, masks -----------------------------------------------------------------


def hostname(endpoint: Column) -> Column:
    """Host part of an endpoint, '' if there is none."""
    return F.regexp_extract(endpoint, HOST_PATTERN, 2)


FULL_HASH = 40


def short_hash(value: Column, width: int = 6) -> Column:
    """The first hex digits of the SHA-1 of the value's text."""
    return F.substring(F.sha1(value.cast("string")), 1, width)


def error_signature(fields: list[Column], width: int | None = None) -> Column:
    """One text per combination of field values: ``|`` and a hash for every field.

    The whole hash makes it a key. A ``width`` of six digits is customary for display, but some
    thousands of texts already collide there.
    """
    return F.concat(*[part for f in fields for part in (F.lit("|"), short_hash(f, width or FULL_HASH))])


def split_feature_name(name: Column) -> Column:
    """``FEATURE_some_value`` as a struct of feature and value."""
    feature = F.substring_index(name, "_", 1)
    return F.struct(
        feature.alias("feature"),
        F.substr(name, F.length(feature) + F.lit(2)).alias("value"),
    )


def text_parts(text: Column) -> Column:
    """The words of a text and the white space between them, in turn."""
    # The white space of Unicode and four separators: the blanks of ``words``, as one test per character.
    return F.regexp_extract_all(text, F.lit(r"(?U)([\s\x1c-\x1f]+|[^\s\x1c-\x1f]+)"), F.lit(1))


def place_ends(parts: Column, places: Column) -> Column:
    """Where in the parts the words at the sorted ``places`` stand, and the number of parts."""
    offset = F.when(F.get(parts, F.lit(0)).rlike(f"^[{OTHER_BLANKS} ]"), 1).otherwise(0)
    return F.array_distinct(F.concat(F.transform(places, lambda p: p * 2 + offset), F.array(F.size(parts))))


def mask_places(parts: Column, ends: Column) -> Column:
    """The text of these parts with the words at the places of ``ends`` (see ``place_ends``) replaced by
    a fixed mark, as far as they are in lower case.

    The places become one flag per part, so the whole is one walk over the parts, however many places there
    are. ``ends`` must be a column, not an expression: it is looked into at every step.
    """

    def stretch(end: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(ends, i - 1))
        return F.concat(F.array_repeat(F.lit(False), (end - before - 1).cast("int")), F.array(F.lit(True)))

    def masked(part: Column, sought: Column) -> Column:
        return F.when(sought & (part == F.lower(part)), F.lit(RARE_WORD_MASK)).otherwise(part)

    return F.array_join(F.zip_with(parts, F.flatten(F.transform(ends, stretch)), masked), "")


def mask_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"\b\d+\b", NUMBER_MASK)
