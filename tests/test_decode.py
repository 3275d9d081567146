"""Decoders against fixed cases and a brute-force reading of the rules."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from labelgauge.functions import decode
from labelgauge.functions.labels import yes_value
from labelgauge.schema import DISPLAY_NAMES, LABELS

PRED = [f"pred_{c}" for c in LABELS]
CLEAN = json.dumps(dict(zip(LABELS, (1, 0, 0, 1, 0, 1))))
BITS, ZEROS = [1, 0, 0, 1, 0, 1], [0] * 6


def run(spark, decoder, replies):
    df = spark.createDataFrame(list(enumerate(replies)), "id int, raw string")
    rows = decoder(df, "raw").orderBy("id").collect()
    return [[r[p] for p in PRED] for r in rows]


FENCED = [
    (CLEAN, BITS),
    (f"```json\n{CLEAN}\n```", BITS),
    (f"Sure! Here it is:\n```json\n{CLEAN}\n```", BITS),
    (f"```\n{CLEAN}\n```", BITS),
    (f"```json\n{CLEAN}", BITS),
    (f"a ```x``` b ```json {CLEAN} ``` c", BITS),
    ("This is not valid JSON", ZEROS),
    ("", ZEROS),
    (None, ZEROS),
    ('{"stereotype": 1, "vilification": 1}', [1, 1, 0, 0, 0, 0]),
    ('{"stereotype": "0", "vilification": "1"}', [0, 1, 0, 0, 0, 0]),
    ('{"stereotype": true, "vilification": "true", "dehumanization": "True"}', [1, 1, 0, 0, 0, 0]),
    ('{"stereotype": 1.0, "vilification": "1.0", "dehumanization": 1e0}', [1, 0, 1, 0, 0, 0]),
    ('{"stereotype": NaN, "vilification": 1}', [0, 1, 0, 0, 0, 0]),
    ('{"stereotype": 0, "stereotype": 1}', [1, 0, 0, 0, 0, 0]),
    ('{"stereotype": 1, "stereotype": 0}', ZEROS),
    ("{'stereotype': 1}", ZEROS),
    ('{"stereotype": 1} as asked', ZEROS),
    ('{"stereotype": 1}, {"stereotype": 1}', ZEROS),
    ('{"stereotype": 1}] [{"a": 1}', ZEROS),
    ('[{"stereotype": 1}]', ZEROS),
    ('{"stereotype": 1,}', ZEROS),
    ('{"Stereotype": 1}', ZEROS),
    (" \n" + CLEAN + " ", BITS),
    ("1", ZEROS),
    ("null", ZEROS),
]


def test_fenced_json_cases(spark):
    got = run(spark, decode.decode_fenced_json, [r for r, _ in FENCED])
    for (reply, want), bits in zip(FENCED, got):
        assert bits == want, reply


BRACED = [
    (f"I think {CLEAN} is right", BITS),
    (CLEAN, BITS),
    ('{"stereotype": "0", "vilification": 2, "dehumanization": "", "invalidation": [0]}',
     [1, 1, 0, 0, 0, 1]),
    ('{"stereotype": "false", "vilification": null, "dehumanization": {}, "invalidation": []}',
     [1, 0, 0, 0, 0, 0]),
    ('{"stereotype": {"a": 0}, "vilification": NaN, "dehumanization": 0.0, "invalidation": -0e2}',
     [1, 1, 0, 0, 0, 0]),
    ("} nothing {", ZEROS),
    ("{ not json }", ZEROS),
    ("", ZEROS),
    (None, ZEROS),
    ('{"stereotype": 1} and {"stereotype": 1}', ZEROS),
]


def test_braced_json_cases(spark):
    got = run(spark, decode.decode_braced_json, [r for r, _ in BRACED])
    for (reply, want), bits in zip(BRACED, got):
        assert bits == want, reply


def test_json_decoders_on_random_objects(spark):
    rng = random.Random(11)
    values = [0, 1, 2, -1, 1.0, 0.0, 1.5, "1", "0", "", "true", "True", "no", True, False, None,
              [], [0], {}, {"x": 1}, math.nan, math.inf, 10**30, "{", "}", 'q"uote', "li\nne", "é"]
    objects = [{c: rng.choice(values) for c in rng.sample(LABELS, rng.randint(0, 6))} for _ in range(300)]
    texts = [json.dumps(o, ensure_ascii=rng.random() < 0.5) for o in objects]

    def counts_as_one(v):
        return v == 1 if isinstance(v, (bool, int, float)) else v in ("1", "true")

    strict = [[int(counts_as_one(o.get(c, 0))) for c in LABELS] for o in objects]
    loose = [[int(bool(o.get(c, 0))) for c in LABELS] for o in objects]
    assert run(spark, decode.decode_fenced_json, texts) == strict
    assert run(spark, decode.decode_braced_json, [f"so {t}!" for t in texts]) == loose


def named(bits, mark=": ", change=str):
    return "\n".join(f"{change(DISPLAY_NAMES[c])}{mark}{b}" for c, b in zip(LABELS, bits))


SIX = [
    (named(BITS), BITS),
    (named(BITS, " = ", str.upper), BITS),
    (named(BITS, " -\n", str.lower), BITS),
    ("\n".join(map(str, BITS)), BITS),
    ("0, 1, 0, 0, 1, 1", [0, 1, 0, 0, 1, 1]),
    ("Stereotype: 1\n" + "\n".join("000000"), ZEROS),
    ("Stereotype: 1\nnumbers 0 0 0 0 0", [1, 0, 0, 0, 0, 0]),
    ("Stereotype: 1\nonly", [1, None, None, None, None, None]),
    ("10 01 a1 1b 0", [None] * 6),
    ("Stereotype: 12, x", [1, None, None, None, None, None]),
    ("", [None] * 6),
    (None, [None] * 6),
    (" 1\t\n\n0 \n 1\n0\n1\n0\n", [1, 0, 1, 0, 1, 0]),
]


def test_six_line_cases(spark):
    got = run(spark, decode.decode_six_lines, [r for r, _ in SIX])
    for (reply, want), bits in zip(SIX, got):
        assert bits == want, reply


def by_the_rules(reply):
    found = []
    for c in LABELS:
        hit = re.search(re.escape(DISPLAY_NAMES[c]) + r"\s*[-:=]\s*([01])", reply, re.I)
        found.append(int(hit[1]) if hit else None)
    if None not in found:
        return found
    alone = [x.strip() for x in reply.split("\n") if x.strip() in ("0", "1")]
    anywhere = re.findall(r"\b[01]\b", reply)
    chosen = alone if len(alone) == 6 else anywhere if len(anywhere) > 5 else None
    return [int(x) for x in chosen[:6]] if chosen else found


def test_six_lines_on_random_replies(spark):
    rng = random.Random(3)
    pieces = ["0", "1", "\n", " ", ": ", "=", "-", ",", "a", "é", "అ", "్", "_", "²", "\r", " ",
              "Stereotype", "vilification", "Lack of Empathy", "0\n", "1\n", "Invalidation: 1\n"]
    replies = ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(600)]
    replies += [named([rng.randint(0, 1) for _ in LABELS]) for _ in range(20)]
    assert run(spark, decode.decode_six_lines, replies) == [by_the_rules(r) for r in replies]


def test_probe_fields(spark):
    replies = [
        "Group: women\nTrigger: 2\nReasoning: a role.\nAnswer: Yes",
        "group:  women \n\nTRIGGER: \nReasoning:\nANSWER: NO",
        "answer: no, then Answer: yes",
        "Answer maybe Reasoning: one line\rstill\nnext",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(replies)), "id int, raw string")
    rows = decode.decode_probe(df, "raw").orderBy("id").collect()
    got = [(r.predicted, r.group, r.trigger, r.reasoning) for r in rows]
    assert got[0] == (1, "women", "2", "a role.")
    assert got[1] == (0, "women", "Reasoning:", "ANSWER: NO")
    assert got[2][0] == 1
    assert got[3] == (None, "", "", "one line\rstill")
    assert got[4] == (None, "", "", "")


@pytest.mark.parametrize(
    "reply,want",
    [("Yes", 1), (" no\n", 0), ("YES it is", 1), ("yes, so", None), ("", None), (" \n", None), (None, None)],
)
def test_first_word(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "raw string")
    assert df.select(decode.first_word_yes_no(F.col("raw"))).first()[0] == want


def test_yes_values_and_defaults(spark):
    df = spark.createDataFrame([("1",), (" true\n",), ("TRUE",), (None,)], "v string")
    trimmed = [r[0] for r in df.select(yes_value(F.col("v"))).collect()]
    assert trimmed == [1, 1, 0, 0]
    assert [r[0] for r in df.select(yes_value(F.col("v"), trim=False)).collect()] == [1, 0, 0, 0]
    rows = spark.createDataFrame([(1, None), (None, None), (0, 1)], "a int, b int")
    got = [(r.a, r.b, r.failed_cells) for r in decode.with_defaults(rows, ["a", "b"]).collect()]
    assert got == [(1, 0, 1), (0, 0, 2), (0, 1, 0)]
    kept = df.select(decode.kept_reply(F.nullif(F.col("v"), F.lit("1")))).collect()
    assert [r[0] for r in kept] == ["API_ERROR", " true\n", "TRUE", "API_ERROR"]


def test_objects_that_repeat_keys_inside_values(spark):
    """Repeated keys in nested values and very long numbers, against a plain reading of the same text."""
    import json

    one, zero = "1." + "0" * 1200, "0." + "0" * 1200
    bodies = [
        '{"a": {"x": 1, "x": 2}, "b": 1}', '{"b": 0, "a": {"b": 1, "b": 1, "c": {"b": [1, {"b": 1, "b": 2}]}}, "b": "1"}',
        '{"a": [{"x": 1, "x": 2}], "b": "true", "a": "\\u0031", "x": {}}', '{"\\u0061": 1, "z": {"a": 0, "a": 0}, "b": []}',
        '{"z": [{"q": "} , \\" : {", "q": 1}], "a": {}, "b": [0]}', '{"z": {"q": 1, "q": 1}, "a": null, "b": ""}',
        f'{{"a": {one}, "b": {zero}, "z": {"9" * 1500}}}', f'{{"a": {zero}, "b": {"9" * 1500}}}', f'{{"a": -{zero}, "b": "{one}"}}',
        '{"z": {"q": 1, "q": 1}, "a": 1', '{"z": {"q": 1, "q": 1}, "a": 1} {}', '{"z": {"q": 1, "q": 1,}, "a": 1}',
    ]

    def truth(body):
        try:
            found = json.loads(body)
        except ValueError:
            return None
        return found

    df = spark.createDataFrame(list(enumerate(bodies)), "id int, raw string")
    fenced = {r.id: r for r in decode.decode_fenced_json(df, "raw", ("a", "b")).collect()}
    braced = {r.id: r for r in decode.decode_braced_json(df, "raw", ("a", "b")).collect()}
    for i, body in enumerate(bodies):
        found = truth(body)
        assert fenced[i].parse_ok == (found is not None), body
        if found is None:
            assert (fenced[i].pred_a, fenced[i].pred_b) == (0, 0)
            continue
        for c in "ab":
            value = found.get(c)
            one_like = not isinstance(value, (list, dict)) and value in (1, "1", True, "true")
            assert fenced[i][f"pred_{c}"] == int(one_like), (c, body)
            assert braced[i][f"pred_{c}"] == int(bool(value)), (c, body)
