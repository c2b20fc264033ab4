"""Queries: readers, normalisation, corpus building and voice lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import corpus, evaluate, normalize
from ..operators.templates import FAMILIES, POOLS
from ..sources import files
from . import fixtures as fx

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None, name=None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


MARKS = ("Suspect :  hi\n Person B: yo", "AGENT: good day   victim: hello", "no marks at all", " caller:a\tUser:b ", "x")
_MARKS_SQL = ", ".join("({}, '{}')".format(i, m.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")) for i, m in enumerate(MARKS))
RAW_TAGS = ("ssn", "support", "refund", "reward", "delivery", "insurance", "telemarketing", "wrong", "appointment", None, "odd")
_TAGS_SQL = ", ".join(f"({i}, {'NULL' if t is None else repr(t)})" for i, t in enumerate(RAW_TAGS))
_TYPE_SQL = """CASE WHEN label = 1 THEN CASE raw WHEN 'ssn' THEN 'govt_impersonation' WHEN 'support' THEN 'tech_support' WHEN 'refund' THEN 'refund_scam' WHEN 'reward' THEN 'prize_scam' ELSE 'unknown_scam' END
  ELSE CASE raw WHEN 'delivery' THEN 'delivery' WHEN 'insurance' THEN 'insurance' WHEN 'telemarketing' THEN 'telemarketing' WHEN 'wrong' THEN 'wrong_number' WHEN 'appointment' THEN 'appointment' ELSE 'none' END END"""
_SPEAKERS = r"trim(regexp_replace(regexp_replace(regexp_replace({t}, '(?i)\b(person a|scammer|suspect|caller|agent)\s*:', 'Caller:', 'g'), '(?i)\b(person b|receiver|innocent|victim|user)\s*:', 'Receiver:', 'g'), '[\s]+', ' ', 'g'))"
RAW_SQL = f"""marks(k, m) AS (VALUES {_MARKS_SQL}), tags(k, raw) AS (VALUES {_TAGS_SQL}),
raws AS (SELECT doc_id, m || ' ' || coalesce(text, '') AS dialogue, raw, CAST(doc_id % 2 AS INT) AS label, source FROM documents JOIN marks ON doc_id % {len(MARKS)} = marks.k JOIN tags ON doc_id % {len(RAW_TAGS)} = tags.k)"""
CORPUS_SQL = f"""{RAW_SQL}, corpus AS (
  SELECT doc_id, source || '-train-' || doc_id AS id, source, {_SPEAKERS.format(t='dialogue')} AS text, label, {_TYPE_SQL} AS scam_type, 'synthetic' AS origin FROM raws)"""


def raws(spark, sf_dir):
    """Documents as a source's raw dialogues: marks of speakers, a source's tag, a label."""
    k = F.col("doc_id")
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.concat(pick(MARKS), F.lit(" "), F.coalesce("text", F.lit(""))).alias("dialogue"), pick(RAW_TAGS).alias("raw"), (k % 2).cast("int").alias("label"), "source")


def records(spark, sf_dir):
    """The corpus in the common schema, with doc_id."""
    r = raws(spark, sf_dir)
    return r.select("doc_id", F.concat_ws("-", "source", F.lit("train"), F.col("doc_id").cast("string")).alias("id"), "source", normalize.normalize_speakers(F.col("dialogue")).alias("text"), "label", normalize.unify_type(F.col("raw"), F.col("label")).alias("scam_type"), F.lit("synthetic").alias("origin"))


@query(f"WITH {RAW_SQL} SELECT doc_id, {_SPEAKERS.format(t='dialogue')} AS text FROM raws")
def normalize_speakers(spark, sf_dir):
    return raws(spark, sf_dir).select("doc_id", normalize.normalize_speakers(F.col("dialogue")).alias("text"))


@query(f"WITH {RAW_SQL} SELECT doc_id, trim(regexp_replace(dialogue, '\\s+', ' ', 'g')) AS text FROM raws")
def collapse_ws(spark, sf_dir):
    return raws(spark, sf_dir).select("doc_id", normalize.collapse_ws(F.col("dialogue")).alias("text"))


@query(f"WITH {RAW_SQL} SELECT doc_id, {_TYPE_SQL} AS scam_type FROM raws")
def unify_type(spark, sf_dir):
    return raws(spark, sf_dir).select("doc_id", normalize.unify_type(F.col("raw"), F.col("label")).alias("scam_type"))


@query(f"WITH {RAW_SQL} SELECT r.doc_id, coalesce(t.tag, 'other') AS tag FROM raws r LEFT JOIN (VALUES ('ssn', 'govt_impersonation'), ('support', 'tech_support'), ('refund', 'refund_scam'), ('reward', 'prize_scam')) t(raw, tag) USING (raw)")
def lookup_joins(spark, sf_dir):
    """A lookup table as a broadcast join; its size is fixed."""
    tags = spark.createDataFrame(list(normalize.SCAM_TAGS.items()), "raw string, tag string")
    return raws(spark, sf_dir).join(F.broadcast(tags), "raw", "left").select("doc_id", F.coalesce("tag", F.lit("other")).alias("tag"))


@query("SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Receiver' WHEN 'assistant' THEN 'Caller' ELSE role END || ': ' || text, ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def turns_to_transcript(spark, sf_dir):
    t = fx.table(spark, sf_dir, "conversations")
    t = t.withColumn("speaker", F.when(F.col("role") == "user", "Receiver").when(F.col("role") == "assistant", "Caller").otherwise(F.col("role")))
    return normalize.turns_to_transcript(t, "conv_id", "turn", "speaker", "text")


@query("SELECT doc_id, trim('Caller: ' || text, ' ' || chr(10) || chr(9)) AS text FROM documents")
def single_speaker_prefix(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", normalize.single_speaker(F.col("text")).alias("text"))


@query("SELECT doc_id, CAST(CAST(quality AS VARCHAR) AS INT) AS label FROM labels")
def label_cast(spark, sf_dir):
    return fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").cast("int").alias("label"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS INT) AS words FROM documents")
def word_count(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", normalize.word_count(F.coalesce("text", F.lit(""))).alias("words"))


@query("SELECT conv_id, trim(string_agg(trim(text), ' ' ORDER BY turn) FILTER (trim(text) <> '')) AS transcript FROM conversations GROUP BY conv_id")
def segments_to_transcript(spark, sf_dir):
    seg = F.struct(F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.concat(F.lit(" "), "text", F.lit("  ")).alias("text"))
    s = fx.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segs"))
    return s.select("conv_id", normalize.segments_to_transcript(F.col("segs")).alias("transcript"))


@query("SELECT page_id, '.' || ext AS suffix FROM (SELECT page_id, (['wav', 'MP3', 'txt', 'webm', 'tar.gz'])[page_id % 5 + 1] AS e, lower(split_part(e, '.', -1)) AS ext FROM pages) WHERE ext IN ('wav', 'mp3', 'm4a', 'ogg', 'webm')")
def recording_ext_filter(spark, sf_dir):
    ends = F.get(F.array(*map(F.lit, ("wav", "MP3", "txt", "webm", "tar.gz"))), (F.col("page_id") % 5).cast("int"))
    p = fx.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/rec/a."), ends).alias("path"))
    return p.withColumn("suffix", normalize.recording_suffix(F.col("path"))).filter(F.col("suffix").isin(*normalize.SUFFIXES)).select("page_id", "suffix")


@query("SELECT doc_id, length(text) >= 1 AS valid, trim(text) <> '' AS scored FROM documents")
def valid_transcript(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", (F.length("text") >= 1).alias("valid"), (F.trim("text") != "").alias("scored"))


_SLUGS = [x.slug for x in corpus.SOURCES]
_NO_TAG = [i for i, x in enumerate(corpus.SOURCES) if x.tag is None]
_ORIGIN_SQL = " ".join(f"WHEN {i} THEN '{x.origin}'" for i, x in enumerate(corpus.SOURCES))


@query(f"""WITH {RAW_SQL}, s AS (SELECT * REPLACE (CASE WHEN doc_id % {len(_SLUGS)} IN ({', '.join(map(str, _NO_TAG))}) THEN NULL ELSE raw END AS raw) FROM raws)
SELECT ({_SLUGS})[doc_id % {len(_SLUGS)} + 1] || '-' || CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END || '-' || doc_id AS id, ({_SLUGS})[doc_id % {len(_SLUGS)} + 1] AS source,
  {_SPEAKERS.format(t='dialogue')} AS text, label, {_TYPE_SQL} AS scam_type, CASE doc_id % {len(_SLUGS)} {_ORIGIN_SQL} END AS origin FROM s""")
def source_adapt(spark, sf_dir):
    """Five sources, each with columns of its own and one it doesn't need, pooled in the common schema."""
    made = []
    for i, x in enumerate(corpus.SOURCES):
        mine = raws(spark, sf_dir).filter(F.col("doc_id") % len(corpus.SOURCES) == i)
        own = mine.select("doc_id", F.col("dialogue").alias(x.text), F.col("label").cast("string").alias(x.label), *([F.col("raw").alias(x.tag)] if x.tag else []), F.lit("calm").alias("personality"))
        made.append(corpus.adapt(own, x, F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test"), F.col("doc_id")))
    return corpus.pool(made).drop("source_rank")


def _jsonl(spark, sf_dir):
    path = files.scratch_path(spark, "calls")
    files.write_calls(records(spark, sf_dir).drop("doc_id"), path)
    return path


@query(f"WITH {CORPUS_SQL} SELECT id, source, text, label, scam_type, origin FROM corpus")
def read_calls_jsonl(spark, sf_dir):
    return files.read_calls(spark, _jsonl(spark, sf_dir))


@query(f"WITH {CORPUS_SQL} SELECT id, label, scam_type, text AS transcript FROM corpus")
def read_eval_calls(spark, sf_dir):
    return files.read_eval_calls(spark, _jsonl(spark, sf_dir))


@query(f"WITH {CORPUS_SQL} SELECT label, count(*) AS n FROM corpus GROUP BY label")
def write_calls_jsonl(spark, sf_dir):
    """Partitioned by label on the way out, counted on the way in."""
    path = files.scratch_path(spark, "calls-by-label")
    files.write_calls(records(spark, sf_dir).drop("doc_id"), path, "label")
    return spark.read.json(path).groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"))


def _split_records(spark, sf_dir):
    return corpus.stratified_split(records(spark, sf_dir), ["label", "source"], "doc_id")


SPLIT_SQL = f"""{CORPUS_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label, source ORDER BY md5(doc_id || '|42'), doc_id) AS r, count(*) OVER (PARTITION BY label, source) AS n FROM corpus),
splits AS (SELECT * EXCLUDE (r, n), CASE WHEN r <= round_even(n * 0.8, 0) THEN 'train' WHEN r <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'test' END AS split FROM ranked)"""


@query(f"WITH {SPLIT_SQL} SELECT id, split FROM splits")
def stratified_split(spark, sf_dir):
    return _split_records(spark, sf_dir).select("id", "split")


@query(f"WITH {SPLIT_SQL} SELECT label, source, split, count(*) AS n FROM splits GROUP BY ALL")
def stratified_split_manual(spark, sf_dir):
    return _split_records(spark, sf_dir).groupBy("label", "source", "split").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN u < 800 THEN 'train' WHEN u < 900 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substring(md5(doc_id || '|42'), 1, 8) AS BIGINT) % 1000 AS u FROM documents)")
def hash_split(spark, sf_dir):
    """The split for large corpora: sizes hold on average, nothing is moved."""
    return corpus.hash_split(fx.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split")


@query(f"WITH {SPLIT_SQL} SELECT id, split, md5(id || '|42') AS place FROM splits")
def seeded_shuffle(spark, sf_dir):
    """Splits in the order of a seeded hash, as they are written; ``place`` is what they are ordered by."""
    return corpus.shuffled(_split_records(spark, sf_dir).select("id", "split"), "split", "id")


@query(f"WITH {SPLIT_SQL} SELECT split, count(*) AS n FROM splits GROUP BY split")
def corpus_count(spark, sf_dir):
    return corpus.counts(_split_records(spark, sf_dir)).filter("facet = 'rows'").select("split", "n")


@query(f"WITH {SPLIT_SQL} SELECT split, CAST(label AS VARCHAR) AS label, count(*) AS n FROM splits GROUP BY ALL")
def label_balance(spark, sf_dir):
    return corpus.counts(_split_records(spark, sf_dir)).filter("facet = 'label'").select("split", F.col("value").alias("label"), "n")


@query(f"WITH {SPLIT_SQL} SELECT split, source, count(*) AS n FROM splits GROUP BY ALL")
def per_source(spark, sf_dir):
    return corpus.counts(_split_records(spark, sf_dir)).filter("facet = 'source'").select("split", F.col("value").alias("source"), "n")


@query(f"WITH {SPLIT_SQL} SELECT split, scam_type, count(*) AS n FROM splits GROUP BY ALL")
def per_scam_type(spark, sf_dir):
    return corpus.counts(_split_records(spark, sf_dir)).filter("facet = 'scam_type'").select("split", F.col("value").alias("scam_type"), "n")


@query(f"WITH {SPLIT_SQL} SELECT split, round_even(avg(w), 2) AS mean_words, CAST(median(w) AS DOUBLE) AS median_words FROM (SELECT split, len(regexp_extract_all(text, '\\S+')) AS w FROM splits) GROUP BY split")
def length_stats(spark, sf_dir):
    return corpus.length_stats(_split_records(spark, sf_dir))


@query(f"WITH {SPLIT_SQL} SELECT split, count(*) AS n, true AS within FROM splits GROUP BY split")
def length_sketch(spark, sf_dir):
    """The median length by sketches made for each source and merged by split: is its exactly counted rank within twice the bound?"""
    s, words, q = _split_records(spark, sf_dir), normalize.word_count(F.col("text")), {"median": 0.5}
    kept = evaluate.merged(evaluate.sketches(s, words, "split", "source"), "split")
    gaps = evaluate.rank_gaps(s, words, evaluate.sketch_quantiles(kept, q, "split"), q, "split")
    return gaps.select("split", "n", (F.col("median") <= 2 * evaluate.rank_error()).alias("within"))


_DEDUP_SQL = "deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS dr FROM corpus) WHERE dr = 1)"
DEDUP_SPLIT_SQL = SPLIT_SQL.replace(", ranked AS (", f", {_DEDUP_SQL}, ranked AS (").replace("AS n FROM corpus)", "AS n FROM deduped)")


@query(f"""WITH {DEDUP_SPLIT_SQL}, words AS (SELECT split, len(regexp_extract_all(text, '\\S+')) AS w FROM splits), sizes AS (SELECT (SELECT count(*) FROM corpus) AS p, (SELECT count(*) FROM splits) AS k)
SELECT split, 'rows' AS facet, NULL::VARCHAR AS value, count(*)::DOUBLE AS n FROM splits GROUP BY ALL UNION ALL SELECT split, 'label', label::VARCHAR, count(*) FROM splits GROUP BY ALL
UNION ALL SELECT split, 'source', source, count(*) FROM splits GROUP BY ALL UNION ALL SELECT split, 'scam_type', scam_type, count(*) FROM splits GROUP BY ALL
UNION ALL SELECT split, 'words', 'mean', round_even(avg(w), 2) FROM words GROUP BY split UNION ALL SELECT split, 'words', 'median', median(w) FROM words GROUP BY split
UNION ALL SELECT '_meta', 'corpus', v, n FROM (SELECT unnest(['pooled', 'dropped', 'seed', 'train', 'val']) AS v, unnest([p, p - k, 42, 0.8::DOUBLE, 0.1::DOUBLE]) AS n FROM sizes)""")
def write_stats(spark, sf_dir):
    """The statistics document of a corpus, written and read back."""
    path = files.scratch_path(spark, "stats")
    pooled = records(spark, sf_dir)
    splits = corpus.stratified_split(corpus.dedup_keep_first(pooled, "text", "doc_id"), ["label", "source"], "doc_id")
    files.write_report({"stats": corpus.statistics(splits, pooled, "text")}, path)
    return spark.read.schema("split string, facet string, value string, n double").json(f"{path}/stats")


@query(f"WITH {CORPUS_SQL} SELECT 'missing_field' AS rule, 0::BIGINT AS n UNION ALL SELECT 'label_range', 0 UNION ALL SELECT 'blank_text', count(*) FROM corpus WHERE trim(text) = ''")
def schema_sanity(spark, sf_dir):
    return corpus.violations(records(spark, sf_dir)).select("rule", F.col("n").cast("long").alias("n"))


@query(f"WITH {CORPUS_SQL}, held AS (SELECT * FROM corpus WHERE source = 'src7'), rest AS (SELECT * FROM corpus WHERE source <> 'src7') SELECT 'source' AS rule, count(*) AS n FROM rest WHERE source IN (SELECT source FROM held) UNION ALL SELECT 'text', count(*) FROM rest WHERE text IN (SELECT text FROM held)")
def heldout_leak_check(spark, sf_dir):
    """One source is held out, the others are split: rows of that source among them raise, rows with its texts are counted."""
    r = records(spark, sf_dir)
    held, rest = r.filter("source = 'src7'"), r.filter("source <> 'src7'")
    return corpus.require(corpus.leaks(corpus.stratified_split(rest, ["label", "source"], "doc_id"), held), "source")


@query(f"""WITH f AS (SELECT doc_id, doc_id % {len(FAMILIES)} AS k FROM documents), labels_(k, label) AS (VALUES {', '.join(f'({i}, {x.label})' for i, x in enumerate(FAMILIES))})
SELECT 'repeated_id' AS rule, count(*) - count(DISTINCT doc_id) AS n FROM f UNION ALL SELECT 'mixed_label', 0 UNION ALL SELECT 'uneven', abs(count(*) FILTER (label = 1) - count(*) FILTER (label = 0)) FROM f JOIN labels_ USING (k)""")
def scenario_asserts(spark, sf_dir):
    """Repeated ids or families with both labels raise; an uneven number of labels is counted."""
    return corpus.require(corpus.scenario_violations(_scenarios(spark, sf_dir), "doc_id", "scenario", "label"), "repeated_id", "mixed_label")


@query("SELECT doc_id, (CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END)::INT AS source_rank FROM documents")
def pool_union(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents")
    known = ("en", "fr", "de")
    return corpus.pool([*[d.filter(F.col("lang") == x) for x in known], d.filter(~F.coalesce(F.col("lang").isin(*known), F.lit(False)))]).select("doc_id", "source_rank")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_keep_first(spark, sf_dir):
    return corpus.dedup_keep_first(fx.table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@query("SELECT count(*) AS pooled, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS dropped FROM documents")
def dedup_meta(spark, sf_dir):
    per_text = fx.table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.count("*").alias("c"))
    return per_text.agg(F.sum("c").alias("pooled"), F.count("*").alias("kept"), F.sum(F.col("c") - 1).alias("dropped"))


@query("SELECT * FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r <= 25 ORDER BY r".replace("SELECT *", "SELECT doc_id", 1))
def limit_items(spark, sf_dir):
    """The first 25 by id; the number is the operator's feature."""
    return fx.table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(25)


@query("WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 3 = 1 THEN 1 ELSE 3 END AS p FROM documents) SELECT doc_id, p FROM s WHERE p = (SELECT min(p) FROM s)")
def strategy_fallback(spark, sf_dir):
    p = F.when(F.col("doc_id") % 3 == 0, 2).when(F.col("doc_id") % 3 == 1, 1).otherwise(3)
    return corpus.first_strategy(fx.table(spark, sf_dir, "documents").select("doc_id", p.alias("p")), "p")


@query("SELECT DISTINCT d.doc_id, b.text IS NOT NULL AS known FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id")
def zip_by_position(spark, sf_dir):
    """Rows are paired by id, never by position."""
    b = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("known"))
    return fx.table(spark, sf_dir, "documents").select("doc_id").join(b, "doc_id", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT 'u' || doc_id AS utt_id, '/audio/u' || doc_id || '.flac' AS path, CAST(doc_id % 3 = 1 AS INT) AS label FROM documents WHERE doc_id % 3 < 2 AND doc_id % 10 <> 9")
def read_spoof_protocol(spark, sf_dir):
    key = F.get(F.array(F.lit("bonafide"), F.lit("spoof"), F.lit("other")), (F.col("doc_id") % 3).cast("int"))
    line = F.when(F.col("doc_id") % 10 == 9, "too short").otherwise(F.concat(F.lit("s1  u"), F.col("doc_id").cast("string"), F.lit(" -\tA01 "), key))
    path = files.scratch_path(spark, "protocol")
    fx.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return files.read_spoof_protocol(spark, path, "/audio")


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'f' || doc_id || '.wav' ELSE 'f' || doc_id || '.mp3' END AS path, CAST(doc_id % 3 = 1 AS INT) AS label FROM documents WHERE doc_id % 3 < 2")
def read_itw_meta(spark, sf_dir):
    k = F.col("doc_id")
    name = F.concat(F.lit("f"), k.cast("string"), F.when(k % 2 == 0, "").otherwise(".mp3"))
    label = F.get(F.array(F.lit("bona-fide"), F.lit(" spoof "), F.lit("?")), (k % 3).cast("int"))
    path = files.scratch_path(spark, "meta")
    fx.table(spark, sf_dir, "documents").select(name.alias(" File"), F.lit("x").alias("Speaker"), label.alias("LABEL ")).write.option("header", True).option("sep", ";").csv(path)
    return files.read_voice_meta(spark, path)


_FOLDERS = ("real", "Fake", "bona-fide", "deepfake", "misc")


def _paths(spark, sf_dir):
    k = F.col("doc_id")
    folder = F.get(F.array(*map(F.lit, _FOLDERS)), (k % 5).cast("int"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/data/"), folder, F.lit("/"), F.when(k % 4 == 0, F.concat(F.lit("n"), k.cast("string"))).otherwise(k.cast("string")), F.lit(".wav")).alias("path"))


_PATHS_SQL = "paths AS (SELECT doc_id, '/data/' || (['real', 'Fake', 'bona-fide', 'deepfake', 'misc'])[doc_id % 5 + 1] || '/' || CASE WHEN doc_id % 4 = 0 THEN 'n' ELSE '' END || doc_id || '.wav' AS path FROM documents)"


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS label FROM documents")
def label_from_folder(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", files.label_from_folder(F.col("path")).alias("label"))


@query(f"WITH {_PATHS_SQL} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS n FROM paths WHERE doc_id % 4 <> 0 GROUP BY 1 ORDER BY n DESC, folder LIMIT 1")
def densest_dir(spark, sf_dir):
    return files.densest_folder(_paths(spark, sf_dir))


@query(f"WITH {_PATHS_SQL}, k AS (SELECT path FROM paths WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT path, (SELECT count(*) FROM paths) - (SELECT count(*) FROM k) AS dropped FROM k")
def drop_missing_files(spark, sf_dir):
    """A label's document counts as a file that exists."""
    p = _paths(spark, sf_dir)
    kept, dropped = files.existing(p, p.join(fx.table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"))
    return kept.select("path", F.lit(dropped).alias("dropped"))


@query("SELECT DISTINCT 'lang=' || lang || '/source=' || source AS folder FROM documents")
def discover_files(spark, sf_dir):
    """Folders found by the files in them, at any depth below a root: here the documents' ids by language and source."""
    path = files.scratch_path(spark, "tree")
    d = fx.table(spark, sf_dir, "documents").select("lang", "source", F.col("doc_id").cast("string").alias("value"))
    d.repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    return files.marked_folders(spark, path, "part-*.txt").select(F.regexp_extract("folder", "(lang=.*)$", 1).alias("folder"))


def _scenarios(spark, sf_dir):
    """(doc_id, scenario, attempt, label): a document stands for an attempt at a family."""
    k = F.col("doc_id") % len(FAMILIES)
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), k.cast("int"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", pick([f.name for f in FAMILIES]).alias("scenario"), F.floor(F.col("doc_id") / len(FAMILIES)).alias("attempt"), pick([f.label for f in FAMILIES]).alias("label"))


def _template_sql() -> str:
    """The same choices as SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pick = lambda xs, what: f"([{', '.join(map(quoted, xs))}])[CAST('0x' || substring(md5(scenario || '|' || attempt || '|{what}|13'), 1, 8) AS BIGINT) % {len(xs)} + 1]"
    lines = [f"WHEN {quoted(f.name)} THEN " + " || ' ' || ".join(f"'{who}: ' || {pick(said, f'turn{i}')}" for i, (who, said) in enumerate(f.turns)) for f in FAMILIES]
    text = f"CASE scenario {' '.join(lines)} END"
    steps = [f"t0 AS (SELECT scenario, attempt, {text} AS text FROM s)"]
    for i, (slot, values) in enumerate(POOLS.items()):
        steps.append(f"t{i + 1} AS (SELECT scenario, attempt, replace(text, '{{{slot}}}', {pick(values, slot)}) AS text FROM t{i})")
    return f"""WITH s AS (SELECT ([{', '.join(quoted(f.name) for f in FAMILIES)}])[doc_id % {len(FAMILIES)} + 1] AS scenario, doc_id // {len(FAMILIES)} AS attempt FROM documents), {', '.join(steps)},
d AS (SELECT scenario, text, min(attempt) AS attempt FROM t{len(POOLS)} GROUP BY ALL) SELECT scenario, attempt, text FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY attempt) AS r FROM d) WHERE r <= 20"""


@query(_template_sql())
def template_expand(spark, sf_dir):
    """Made-up calls of all families; 20 for each is the operator's feature."""
    return corpus.expand_templates(_scenarios(spark, sf_dir), [(f.name, list(f.turns)) for f in FAMILIES], POOLS, keep=20)


@query(f"""WITH c(k, scenario, scam_type, label, turns) AS (VALUES {', '.join(f"({i}, '{f.name}', '{f.scam_type}', {f.label}, {len(f.turns)})" for i, f in enumerate(FAMILIES))})
SELECT scenario, scam_type, label, turns, count(doc_id) AS attempts FROM c LEFT JOIN documents ON doc_id % {len(FAMILIES)} = k GROUP BY ALL""")
def scenario_catalog(spark, sf_dir):
    """The families, and how many attempts the table holds for each."""
    catalog = spark.createDataFrame([(f.name, f.scam_type, f.label, len(f.turns)) for f in FAMILIES], "scenario string, scam_type string, label int, turns int")
    n = _scenarios(spark, sf_dir).groupBy("scenario").agg(F.count("*").alias("attempts"))
    return catalog.join(n, "scenario", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id")
def session_isolation(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return fx.table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).filter("r = 1").select("user_id", F.col("event_id").alias("first_event"))
