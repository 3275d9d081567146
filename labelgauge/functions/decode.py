"""Reply decoding: from what a model answered to label columns."""

from pyspark.sql import functions as F

from labelgauge.functions.text import LINE_SPACE, NOT_SPACE, SPACE, strip
from labelgauge.schema import DISPLAY_NAMES, LABELS

# An extra list entry behind the reply; where it does not come out again, the reply held more
# or less than one JSON object.
_TAIL = "#tail"

# The JSON values that count as 1, and those that count as false.
ONE_VALUES = ("1", "1.0", '"1"', "true", '"true"')
FALSE_VALUES = ("0", "0.0", "-0.0", '""', "false", "null", "[]", "{}")

# The tokens of JSON text: strings, brackets and marks, anything else.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]+'

_WORD = r"[\p{L}\p{N}_]"
_BARE_BIT = f"(?<!{_WORD})([01])(?!{_WORD})"
_BIT_LINE = f"(?:^|\\n){LINE_SPACE}*([01]){LINE_SPACE}*(?=\\n|\\z)"


def decode_six_lines(df, raw_col, display_names=DISPLAY_NAMES, prefix="pred_"):
    """Labelled lines first; else lines of bare digits; else the first bare digits anywhere.

    When a label is missing among the labelled lines, the later forms replace *all* labels.
    A label no form yields stays null.
    """
    raw, names = F.col(raw_col), list(display_names)
    named = [
        F.regexp_extract(
            raw, f"(?iu)\\Q{display_names[name]}\\E{SPACE}*[:=\\-]{SPACE}*([01])", 1
        ).alias(name)
        for name in names
    ]
    k = len(names)
    incomplete = F.expr(" OR ".join(f"_named.`{n}` = ''" for n in names))
    lines = F.regexp_extract_all(raw, F.lit(_BIT_LINE), F.lit(1))
    digits = F.regexp_extract_all(raw, F.lit(_BARE_BIT), F.lit(1))
    df = df.withColumn("_named", F.struct(*named))
    df = df.withColumn("_lines", F.when(incomplete, lines))
    df = df.withColumn("_digits", F.when(incomplete & (F.size("_lines") != k), digits))
    picked = {
        prefix + n: F.expr(
            f"""int(CASE WHEN size(_lines) = {k} THEN get(_lines, {i})
                WHEN size(_digits) >= {k} THEN get(_digits, {i})
                ELSE nullif(_named.`{n}`, '') END)"""
        )
        for i, n in enumerate(names)
    }
    return df.withColumns(picked).drop("_named", "_lines", "_digits")


def _unquoted(token):
    """SQL for the text of a JSON string token."""
    return f"""if(contains({token}, '\\\\'), get(from_json(concat('[', {token}, ']'), 'array<string>'), 0),
        substring({token}, 2, length({token}) - 2))"""


def _last_values(tokens, labels):
    """SQL: the labels among an object's own keys with the start of their values, in order, from its JSON tokens.

    One pass over the tokens keeps the depth; what stands inside the values of keys is passed over. A scalar
    comes as its token, an empty list or object as ``[]`` or ``{}``, any other one as its first bracket.
    """
    none = "CAST(NULL AS string)"
    empty = "CAST(array() AS array<struct<k: string, v: string>>)"
    put = f"if(s.key IN ({_quoted(labels)}), array(named_struct('k', s.key, 'v', x)), {empty})"

    def state(d="s.d", word=none, key="s.key", value="false", fresh="false", out="s.out"):
        return f"named_struct('d', {d}, 'word', {word}, 'key', {key}, 'value', {value}, 'fresh', {fresh}, 'out', {out})"

    opened = state("s.d + 1", fresh="s.d = 1 AND s.value", out=f"if(s.d = 1 AND s.value, concat(s.out, {put}), s.out)")
    closed_empty = f"""if(s.fresh AND s.key IN ({_quoted(labels)}), concat(slice(s.out, 1, size(s.out) - 1),
        array(named_struct('k', s.key, 'v', concat(element_at(s.out, -1).v, x)))), s.out)"""
    return f"""aggregate({tokens}, {state("0", key=none, out=empty)}, (s, x) -> CASE
        WHEN x IN ('{{', '[') THEN {opened}
        WHEN x IN ('}}', ']') THEN {state("s.d - 1", out=closed_empty)}
        WHEN s.d <> 1 OR x = ',' THEN {state(value="false")}
        WHEN x = ':' THEN {state(key=_unquoted("s.word"), value="true")}
        WHEN s.value THEN {state(out=f"concat(s.out, {put})")}
        ELSE {state(word="x")} END).out"""


def _plain(value):
    """SQL: a value's token as the JSON text that the lists of values have: numbers short, strings without escapes."""
    return f"""CASE WHEN startswith({value}, '"') THEN concat('"', {_unquoted(value)}, '"')
        WHEN try_cast({value} AS double) = 1 THEN '1' WHEN try_cast({value} AS double) = 0 THEN '0' ELSE {value} END"""


def _decode_object(df, body, labels, prefix, to_bit):
    """Read ``body`` as exactly one strict JSON object; the last of equal keys counts.

    ``to_bit`` is the SQL condition under which ``value``, the JSON text of a label, means 1. Values are read
    as variants; an object that these refuse (keys repeated inside a value, say) but that is JSON is
    read once more token by token, for its own keys only.
    """
    fields = ", ".join(f"`{name}` variant" for name in labels)
    options = {"allowSingleQuotes": "false", "maxNumLen": str(2**31 - 1)}
    listed = F.concat(F.lit("["), F.col("_body"), F.lit(f',{{"{_TAIL}":1}}]'))
    framed = "startswith(_body, '{') AND endswith(_body, '}')"

    def whole(read):
        return f"coalesce({framed} AND size({read}) = 2 AND get({read}, 1).`{_TAIL}` = 1, false)"

    tail_only = F.from_json(listed, f"array<struct<`{_TAIL}`: int>>", options)
    df = df.withColumn("_body", body)
    df = df.withColumn("_json", F.from_json(listed, f"array<struct<{fields}, `{_TAIL}`: int>>", options))
    # a label without a value is missing, or its value was refused: then its name stands in the text
    doubt = " OR ".join(
        f"get(_json, 0).`{n}` IS NULL AND (contains(_body, '\"{n}\"') OR contains(_body, '\\\\u'))" for n in labels
    )
    df = df.withColumn("_read", F.expr(f"{whole('_json')} AND NOT ({doubt})"))
    df = df.withColumn("_tail", F.when(~F.col("_read") & F.expr(framed), tail_only))
    df = df.withColumn("parse_ok", F.expr(f"_read OR {whole('_tail')}"))
    tokens = F.regexp_extract_all("_body", F.lit(_TOKEN), F.lit(0))
    df = df.withColumn("_tokens", F.when(F.col("parse_ok") & ~F.col("_read"), tokens))
    df = df.withColumn("_last", F.expr(f"if(_tokens IS NOT NULL, {_last_values('_tokens', labels)}, NULL)"))
    bits = {}
    for n in labels:
        read = to_bit.format(value=f"to_json(get(_json, 0).`{n}`)")
        last = f"slice(filter(_last, e -> e.k = '{n}'), -1, 1)"
        kept = f"exists(transform({last}, e -> {_plain('e.v')}), v -> {to_bit.format(value='v')})"
        bits[prefix + n] = F.expr(f"int(if(_read, coalesce({read}, false), parse_ok AND coalesce({kept}, false)))")
    return df.withColumns(bits).drop("_body", "_json", "_read", "_tail", "_tokens", "_last")


def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


def decode_fenced_json(df, raw_col, labels=LABELS, prefix="pred_"):
    """The JSON object in the first fence (or the whole reply); 1 for 1, "1", true, "true".

    Missing keys and unreadable replies give 0; ``parse_ok`` tells the latter apart.
    """
    df = df.withColumn("_raw", strip(F.col(raw_col)))
    body = F.expr(
        """CASE WHEN contains(_raw, '```json')
                THEN split_part(split_part(_raw, '```json', 2), '```', 1)
            WHEN contains(_raw, '```') THEN split_part(_raw, '```', 2)
            ELSE _raw END"""
    )
    is_one = f"{{value}} IN ({_quoted(ONE_VALUES)})"
    return _decode_object(df, strip(body), labels, prefix, is_one).drop("_raw")


def decode_braced_json(df, raw_col, labels=LABELS, prefix="pred_"):
    """The text from the first ``{`` to the last ``}``; any value that is not false-like is 1."""
    body = F.regexp_extract(F.col(raw_col), r"(?s)(\{.*\})", 1)
    not_false = f"{{value}} NOT IN ({_quoted(FALSE_VALUES).replace('{}', '{{}}')})"
    return _decode_object(df, body, labels, prefix, not_false)


def yes_no(raw):
    """1 for "answer: yes", 0 for "answer: no", null for neither; yes wins."""
    low = F.lower(raw)
    return F.when(low.contains("answer: yes"), 1).when(low.contains("answer: no"), 0)


def field_value(raw, field):
    """What follows ``field:`` up to the end of its line, '' when absent.

    An empty field takes the next line, as whitespace after the colon may span lines.
    """
    found = F.regexp_extract(raw, f"(?iu){field}:{SPACE}*([^\\n]+)", 1)
    return strip(F.coalesce(found, F.lit("")))


def first_word_yes_no(raw):
    """1 or 0 by the first word of the reply, null for any other word or an empty reply."""
    word = F.lower(F.regexp_extract(raw, f"^{SPACE}*({NOT_SPACE}+)", 1))
    return F.when(word == "yes", 1).when(word == "no", 0)


def decode_probe(df, raw_col):
    """The probe's answer and its explaining fields."""
    raw = F.col(raw_col)
    return df.withColumns(
        {
            "predicted": yes_no(raw),
            "group": field_value(raw, "Group"),
            "trigger": field_value(raw, "Trigger"),
            "reasoning": field_value(raw, "Reasoning"),
        }
    )


def kept_reply(raw, sentinel="API_ERROR"):
    """The reply, or ``sentinel`` where none came."""
    return F.coalesce(F.nullif(raw, F.lit("")), F.lit(sentinel))


def with_defaults(df, columns):
    """Null predictions to 0, with the number of such cells in ``failed_cells``."""
    failed = " + ".join(f"int(`{c}` IS NULL)" for c in columns)
    df = df.withColumn("failed_cells", F.expr(failed))
    return df.withColumns({c: F.expr(f"coalesce(`{c}`, 0)") for c in columns})
