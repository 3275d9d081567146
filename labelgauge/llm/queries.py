"""The numbered operators over the whole given tables, with production parameters."""

from pyspark.sql import functions as F

from labelgauge.llm import chat, decontam, langid, licenses, merkle, mixing, near_dedup, quality_nb, quality_rules, runs, warc, wrappers
from labelgauge.llm.suffix_dedup import remove_repeats
from labelgauge.session import shared_dir

QUERIES, ORACLES = {}, {}


def query(sql=None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op7_suffix_array_dedup(spark, sf):
    """Per document: what stays when every 200-byte string that occurs twice or more is removed."""
    rows = remove_repeats(table(spark, sf, "documents").select("doc_id", "text"), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op4_dart_minhash(spark, sf):
    """Per document: the near-duplicate class (its first doc_id), its size, and whether it is the first."""
    docs = table(spark, sf, "documents")
    classes = near_dedup.near_classes(docs)
    real = F.when(F.col("class_id") > -(2**63), F.col("class_id"))
    first = (F.col("id_") == F.col("class_id")) & (F.col("hash_") == F.col("class_hash"))
    own = F.when(F.col("id_") > -(2**63), F.col("id_"))
    return classes.select(own.alias("doc_id"), real.alias("class_id"), "n_texts", first.alias("kept"))


@query()
def op2_qgram_decontamination(spark, sf):
    """Per document and benchmark item found in it: the segments, the least edits, the bytes spanned."""
    return decontam.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op6_pfair_mixing(spark, sf):
    """Per document: its slot and place in the mix of the sources by the roots of their sizes."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    mixed = mixing.mix(docs, mixing.root_weights(docs), order=("doc_id",))
    return mixed.select("doc_id", "source", "slot", "place", "in_mix")


def remainder(n):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(-1))


@query()
def op10_quality_classifier(spark, sf):
    """Per document: the probability of quality label 1, learned from rows whose remainder is not 1."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = docs.where(remainder(3) != 1)
    model = quality_nb.fit(quality_nb.labelled(known, table(spark, sf, "labels")), key="doc_id")
    return quality_nb.score(docs, model).select(
        "doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query()
def op5_quality_rules(spark, sf):
    """Per document: the counts, whether the base rules fail, and the verdict of the likelihood ratio."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct().withColumn("target", F.lit(True))
    # labels grow with the documents, so they are never broadcast
    found = quality_rules.ratios(docs.join(good.hint("merge"), "doc_id", "left"))
    return quality_rules.judge(docs, found).drop("text")


CHAT_SQL = r"""WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 0 AS own FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok', 0), (-7, 1, 'assistant', '\### Assistant: </turn> ok', 0)),
turns AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) AS n_text,
    length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c')) AS n_role
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_text + n_role + 14) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


@query(CHAT_SQL)
def op3_chat_formatting(spark, sf):
    """Per conversation: digests of the turns and of the text to learn from, read back from the output."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    mark = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), mark.alias("text"),
    )
    done = chat.rendered(chat.messages(chat.streamed(rows.unionByName(more))))
    done = done.withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("loss", chat.learned(F.col("formatted"), F.col("spans")))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op1_language_id(spark, sf):
    """Per document: the language of the nearest centroid, learned from rows whose remainder is not 2."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(remainder(4) != 2), key="doc_id")
    found = langid.classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


WARC_SQL = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload)
SELECT page_id, strlen(p.payload) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
    (instr('0123456789abcdef', h[5 * i // 4 + 1]) - 1) * 16 + instr('0123456789abcdef', h[5 * i // 4 + 2]) - 1)
    >> (3 - 5 * i % 4)) & 31)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload)"""


@query(WARC_SQL)
def op8_arc_to_warc(spark, sf):
    """Per page: what its WARC record says, converted from ARC, written, and read back."""
    records = warc.with_revisits(warc.converted(warc.as_arc(table(spark, sf, "pages"))))
    path = warc.write_warc(records, shared_dir(spark, "warc"))
    back = warc.read_warc(spark, path)
    intact = F.assert_true("intact", F.lit("a record was not read back as it was written"))
    return back.where(intact.isNull()).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def file_paths(docs):
    """Documents as files in folders by hundreds and tens; the first of each is the folder's licence file."""
    tens, hundreds = (F.floor(F.col("doc_id") / n).cast("string") for n in (10, 100))
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    deep = F.concat_ws("/", hundreds, tens, name)
    path = F.when(F.col("doc_id") % 100 == 0, F.concat_ws("/", hundreds, name)).otherwise(deep)
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


@query()
def op9_license_scan(spark, sf):
    """Per document: the licence its lines state, or the one inherited from a directory above it."""
    files = file_paths(table(spark, sf, "documents").select("doc_id", "text"))
    found = licenses.licensed(files.select("path", "text"))
    return files.select("doc_id", "path").join(found, "path", "left").select(
        "doc_id", "license", "score", F.coalesce("how", F.lit("none")).alias("how"), "source_directory"
    )


def looped(text, key):
    """Every tenth text with its words from one on repeated at a period, both told by the key's checksum."""
    h, words = F.crc32(key.cast("string")), F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    with_words = F.struct(words.alias("w"), F.floor(h / 10).alias("g"), F.size(words).cast("long").alias("n"))

    def loop(x):
        a = x["g"] % x["n"]
        p = F.floor((x["n"] - a) / (x["g"] % 8 + 3)) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + F.try_mod(i - a, p)).cast("int")
        again = F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(x["w"], place(i)))
        return F.when(x["n"] > 0, F.array_join(again, " ")).otherwise(text)

    return F.when(h % 10 == 0, F.transform(F.array(with_words), loop)[0]).otherwise(text)


@query()
def op13_periodic_runs(spark, sf):
    """Per document: its periodic runs of words, the longest of them, and a digest of the text without repeats."""
    docs = table(spark, sf, "documents").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    found, best = runs.with_runs(docs), F.col("best")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", runs.longest_run(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _merkle_sql(depth=6):
    """The trees level by level as runs of 16 nodes, each row folded through them; up to 16 ** depth nodes a tree."""
    ctes = []

    def tree(t):
        """From {t}_l0 (g, pos, n, node): the levels {t}_l and their runs {t}_r."""
        for i in range(depth):
            ctes.append(f"""{t}_r{i} AS (SELECT g, pos // 16 AS run, any_value(n) AS n, string_agg(node, '' ORDER BY pos) AS s
  FROM {t}_l{i} GROUP BY g, pos // 16)""")
            ctes.append(f"""{t}_l{i + 1} AS (SELECT g, run AS pos, count(*) OVER (PARTITION BY g) AS n,
  CASE WHEN n > 1 THEN sha256(s) ELSE s END AS node FROM {t}_r{i})""")

    def fold(rows, t):
        """From {rows}0 (doc_id, leaf, subroot, g, pos, x, proof): the rows folded through the runs of tree t."""
        for i in range(depth):
            ctes.append(f"""{rows}{i + 1} AS (SELECT doc_id, leaf, subroot, g, pos // 16 AS pos,
  CASE WHEN r.n > 1 THEN sha256(s[:64 * (pos % 16)] || x || s[64 * (pos % 16) + 65:]) ELSE x END AS x,
  CASE WHEN r.n > 1 THEN proof || s[:64 * (pos % 16)] || s[64 * (pos % 16) + 65:] ELSE proof END AS proof
  FROM {rows}{i} JOIN {t}_r{i} AS r USING (g) WHERE r.run = pos // 16)""")

    def leaf(text):
        cells = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in cells) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT),
  lambda c, d: list_reduce([xor(c, d)] || range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
    ctes.append(f"""leaves AS (SELECT doc_id, coalesce('1' || source, '0') AS g, {leaf("text")} AS node,
  CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} END AS other FROM documents)""")
    ctes.append("""d AS (SELECT *, count(*) OVER (PARTITION BY g) AS n,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM leaves)""")
    ctes.append("d_l0 AS (SELECT g, pos, n, node FROM d)")
    tree("d")
    ctes.append(f"""s AS (SELECT g AS name, node, '' AS g, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS pos
  FROM d_l{depth})""")
    ctes.append("s_l0 AS (SELECT g, pos, n, node FROM s)")
    tree("s")
    ctes.append("""a0 AS (SELECT doc_id, d.node AS leaf, s.node AS subroot, d.g, d.pos, coalesce(other, d.node) AS x, '' AS proof
  FROM d JOIN s ON name = d.g)""")
    fold("a", "d")
    ctes.append(f"b0 AS (SELECT doc_id, leaf, subroot, '' AS g, s.pos, x, proof FROM a{depth} AS a JOIN s ON name = a.g)")
    fold("b", "s")
    return f"""WITH {", ".join(ctes)}
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = node AS verified
FROM b{depth} JOIN s_l{depth} USING (g)"""


@query(_merkle_sql())
def op11_merkle_manifest(spark, sf):
    """Per document: its leaf, its source's root, the root, its proof, and what a tampered text leads to."""
    docs = table(spark, sf, "documents")
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_hash(*cells, lower))
    rows = docs.select("doc_id", "source", merkle.leaf_hash(*cells, F.col("text")).alias("leaf"), other.alias("other"))
    return merkle.Manifest(rows, "source", "doc_id", "leaf", "other", keep=["doc_id"]).proofs()


PAGE_SQL = r"""WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's') AS a FROM pages),
parts AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(p|h1)>'), lambda x: trim(regexp_replace(
  replace(replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'),
    '&quot;?', '"', 'g'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))) AS b FROM body),
texts AS (SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10)) AS text FROM parts)
SELECT page_id, url, text, length(text) AS n_chars FROM texts"""


@query(PAGE_SQL)
def op12_html_extraction(spark, sf):
    """Per page: the main text, by the wrapper of its host."""
    pages = wrappers.main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
