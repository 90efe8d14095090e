"""Transcripts, text detections, model responses, prompts and audio frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from rushes.functions import media, prompts, responses
from rushes.operators import aggregates, joins, segments
from rushes.plans.bindings import OBS, observations, table
from rushes.plans.registry import query


# --- audio -----------------------------------------------------------------------------------------------

def pcm(spark, sf_dir):
    """PCM frames from vectors: ``file_id`` (label), ``i`` (0, 1, ... in vector order), ``samples``."""
    vectors = table(spark, sf_dir, "embeddings")
    scaled = F.transform(
        "embedding", lambda x: (x.cast("double") * 1000 * (F.col("label") + 1)).cast("smallint")
    )
    rows = vectors.select(F.col("label").cast("long").alias("file_id"), "vec_id", scaled.alias("samples"))
    return segments.frame_index(rows, ["file_id"], "vec_id").withColumnRenamed("frame_index", "i")


PCM = """pcm AS (
  SELECT label::BIGINT AS file_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i,
         list_transform(embedding, lambda x: trunc(x::DOUBLE * 1000 * (label + 1))::INT) AS s
  FROM embeddings
), measured AS (
  SELECT file_id, vec_id, i, sqrt(list_sum(list_transform(s, lambda x: x::DOUBLE * x)) / len(s)) AS energy,
         list_sum(list_transform(range(2, len(s) + 1), lambda j: ((s[j] >= 0) <> (s[j - 1] >= 0))::INT)) / (len(s) - 1)::DOUBLE
           AS crossing_rate
  FROM pcm
), speech AS (SELECT *, energy >= 350 AND crossing_rate BETWEEN 0.05 AND 0.5 AS is_speech FROM measured)"""


@query("speech_frames", "WITH " + PCM + """
SELECT vec_id, round(energy, 6) AS energy, round(crossing_rate, 6) AS crossing_rate, is_speech FROM speech""")
def speech_frames(spark, sf_dir):
    return aggregates.speech_frames(pcm(spark, sf_dir)).select(
        "vec_id", F.round("energy", 6).alias("energy"), F.round("crossing_rate", 6).alias("crossing_rate"), "is_speech"
    )


@query("speech_runs", "WITH " + PCM + """, marked AS (
  SELECT *, i - row_number() OVER (PARTITION BY file_id, is_speech ORDER BY i) AS grp,
         count(*) OVER (PARTITION BY file_id) AS n FROM speech
), runs AS (SELECT file_id, min(i) AS a, max(i) + 1 AS b, max(n) AS n FROM marked WHERE is_speech GROUP BY file_id, grp)
SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY a) - 1)::BIGINT AS run, round(a * 0.03::DOUBLE, 6) AS "start",
       round(least(b, n) * 0.03::DOUBLE, 6) AS "end" FROM runs""")
def speech_runs(spark, sf_dir):
    runs = segments.true_runs(aggregates.speech_frames(pcm(spark, sf_dir)))
    return runs.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


@query("speech_stats", "WITH " + PCM + """
SELECT file_id, count(*)::BIGINT AS n_frames, round(count(*) FILTER (is_speech) / count(*), 3) AS speech_ratio,
       round(count(*) FILTER (is_speech) * 0.03::DOUBLE, 6) AS speech_seconds,
       CASE WHEN count(*) FILTER (is_speech) * 0.03 >= 0.5 AND count(*) FILTER (is_speech) / count(*) > 0.1
            THEN 'speech' ELSE 'audio' END AS audio_content
FROM speech GROUP BY file_id""")
def speech_stats(spark, sf_dir):
    stats = aggregates.speech_stats(aggregates.speech_frames(pcm(spark, sf_dir)))
    return stats.withColumn("speech_seconds", F.round("speech_seconds", 6))


CHANNELS = OBS + """, energy AS (
  SELECT file_id, floor(t)::BIGINT AS segment, CASE label WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
           WHEN 'signup' THEN 3 ELSE 4 END AS channel, sum(intensity) AS rms
  FROM obs GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id, segment ORDER BY rms DESC, channel) AS r FROM energy
), dominant AS (
  SELECT file_id, segment, max(channel) FILTER (r = 1) AS channel,
         CASE WHEN coalesce(max(rms) FILTER (r = 2), 0) > 0 THEN max(rms) FILTER (r = 1) / max(rms) FILTER (r = 2) END AS ratio
  FROM ranked GROUP BY file_id, segment)"""


def channel_energy(spark, sf_dir):
    names = {"view": 0, "click": 1, "purchase": 2, "signup": 3, "error": 4}
    channel = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    obs = observations(spark, sf_dir)
    return obs.groupBy(
        "file_id", F.floor("t").alias("segment"), F.element_at(channel, F.col("label")).alias("channel")
    ).agg(F.sum("intensity").alias("rms"))


@query("dominant_channel", "WITH " + CHANNELS + """
SELECT file_id, segment, channel::INT AS channel, round(ratio, 5) AS ratio FROM dominant""")
def dominant_channel(spark, sf_dir):
    out = aggregates.dominant_channel(channel_energy(spark, sf_dir))
    finite = F.when(F.col("ratio") != float("inf"), F.round("ratio", 5))
    return out.withColumn("ratio", finite)


@query("channel_mode", "WITH " + CHANNELS + """
SELECT file_id, bool_or(ratio IS NULL) OR avg(ratio) > 1.5 AS use_channels FROM dominant GROUP BY file_id""")
def channel_mode(spark, sf_dir):
    return aggregates.channel_mode(aggregates.dominant_channel(channel_energy(spark, sf_dir))).select("file_id", "use_channels")


@query("active_channels", "WITH " + PCM + """
SELECT file_id, (vec_id % 4)::BIGINT AS channel, round(avg(is_speech::INT), 6) AS speech_ratio, avg(is_speech::INT) > 0.1 AS is_active
FROM speech GROUP BY ALL""")
def active_channels(spark, sf_dir):
    frames = aggregates.speech_frames(pcm(spark, sf_dir)).withColumn("channel", F.col("vec_id") % 4)
    return aggregates.active_channels(frames).withColumn("speech_ratio", F.round("speech_ratio", 6))


@query("channel_correlation", """
SELECT label::BIGINT AS file_id, round(corr(e.embedding[d]::DOUBLE, e.embedding[d + 1]::DOUBLE), 6) AS correlation
FROM embeddings e, range(1, 64) r(d) GROUP BY label""")
def channel_correlation(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.arrays_zip(F.slice("embedding", 1, 63).alias("a"), F.slice("embedding", 2, 63).alias("b"))
    waves = vectors.select(F.col("label").cast("long").alias("file_id"), F.explode(shifted).alias("w"))
    waves = waves.select("file_id", F.col("w.a").cast("double").alias("a"), F.col("w.b").cast("double").alias("b"))
    return aggregates.channel_correlation(waves).withColumn("correlation", F.round("correlation", 6))


# --- transcripts -----------------------------------------------------------------------------------------

def transcript(spark, sf_dir):
    """Segments of five seconds per turn, and speaker turns that reach into their neighbours."""
    conv = table(spark, sf_dir, "conversations")
    start = F.col("turn") * 5.0
    segs = conv.select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"), start.alias("start"), (start + 5.0).alias("end"),
        F.length("text").cast("long").alias("n_chars"),
    )
    turns = conv.select(
        F.col("conv_id").alias("file_id"), F.col("turn").alias("idx"),
        (start - F.length("text") % 7).alias("start"), (start + 1 + F.length("text") % 11).alias("end"),
        F.col("role").alias("speaker"),
    )
    return segs, turns


TALK = """segs AS (
  SELECT conv_id AS file_id, turn AS idx, turn * 5.0::DOUBLE AS "start", turn * 5.0::DOUBLE + 5 AS "end", length(text) AS n_chars
  FROM conversations
), turns AS (
  SELECT conv_id AS file_id, turn AS idx, turn * 5.0::DOUBLE - length(text) % 7 AS "start",
         turn * 5.0::DOUBLE + 1 + length(text) % 11 AS "end", role AS speaker
  FROM conversations)"""


@query("assign_by_overlap", "WITH " + TALK + """, ranked AS (
  SELECT s.file_id, s.idx, t.speaker, least(s."end", t."end") - greatest(s."start", t."start") AS overlap,
         row_number() OVER (PARTITION BY s.file_id, s.idx
           ORDER BY least(s."end", t."end") - greatest(s."start", t."start") DESC, t.idx) AS r
  FROM segs s JOIN turns t ON s.file_id = t.file_id AND t."start" < s."end" AND t."end" > s."start")
SELECT s.file_id, s.idx, s."start", s."end", r.speaker, r.overlap
FROM segs s LEFT JOIN ranked r ON r.file_id = s.file_id AND r.idx = s.idx AND r.r = 1""")
def assign_by_overlap(spark, sf_dir):
    segs, turns = transcript(spark, sf_dir)
    return joins.assign_by_overlap(segs.drop("n_chars"), turns)


@query("speaker_stats", "WITH " + TALK + """
SELECT file_id, speaker, sum("end" - "start") AS total_duration, count(*)::BIGINT AS n_turns FROM turns GROUP BY ALL""")
def speaker_stats(spark, sf_dir):
    return aggregates.speaker_stats(transcript(spark, sf_dir)[1])


@query("speaker_count", "SELECT conv_id AS file_id, count(DISTINCT role)::BIGINT AS speaker_count FROM conversations GROUP BY 1")
def speaker_count(spark, sf_dir):
    return aggregates.speaker_count(transcript(spark, sf_dir)[1])


@query("cross_reference", "WITH " + TALK + """
SELECT s.file_id, s.n_chars % 3 AS person, t.speaker,
       sum(least(s."end", t."end") - greatest(s."start", t."start")) AS seconds, count(*)::BIGINT AS n_overlaps
FROM segs s JOIN turns t ON s.file_id = t.file_id AND t."start" < s."end" AND t."end" > s."start" GROUP BY ALL""")
def cross_reference(spark, sf_dir):
    segs, turns = transcript(spark, sf_dir)
    return joins.cross_reference(segs.withColumn("person", F.col("n_chars") % 3), turns)


@query("choose_language", """
SELECT doc_id, CASE WHEN source = 'src0' THEN 'no' WHEN (doc_id % 10) / 10.0 < 0.7 AND n_chars / 100.0 < 15 THEN 'en' ELSE lang END AS language,
       source <> 'src0' AND (doc_id % 10) / 10.0 < 0.7 AND n_chars / 100.0 < 15 AS fallback_applied
FROM documents""")
def choose_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    forced = F.when(F.col("source") == "src0", "no")
    chosen = media.choose_language(forced, "lang", (F.col("doc_id") % 10) / 10.0, F.col("n_chars") / 100.0, F.lit("en"))
    return docs.select("doc_id", chosen.alias("c")).select("doc_id", "c.*")


@query("query_gate", """
SELECT doc_id, CASE WHEN length(trim(w)) >= 3 THEN lang END AS source_lang,
       coalesce(CASE WHEN length(trim(w)) >= 3 THEN lang END <> 'en', false) AS needs_translation
FROM (SELECT doc_id, lang, text AS w FROM documents)""")
def query_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("w"))
    return docs.select("doc_id", media.query_gate("w", "lang").alias("g")).select("doc_id", "g.*")


def document_lines(spark, sf_dir):
    """Lines of documents as text detections: ``file_id, t, idx, text``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return docs.select(
        F.col("doc_id").alias("file_id"), F.floor(F.col("n") / 3).alias("t"), F.col("n").cast("long").alias("idx"), "text",
        (F.col("n") % 5 / 4.0).alias("confidence"),
    )


LINES = """lines AS (
  SELECT doc_id AS file_id, (n - 1) // 3 AS t, n - 1 AS idx, l AS text, (n - 1) % 5 / 4.0 AS confidence
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents))"""


@query("first_seen", "WITH " + LINES + """
SELECT file_id, t::BIGINT AS t, idx::BIGINT AS idx, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id, lower(trim(text, ' ')) ORDER BY t, idx) AS r FROM lines) WHERE r = 1""")
def first_seen(spark, sf_dir):
    seen = segments.first_seen(document_lines(spark, sf_dir))
    return seen.select("file_id", "t", "idx", F.md5("text").alias("text_md5"))


@query("first_seen_confident", "WITH " + LINES + """
SELECT file_id, idx::BIGINT AS idx FROM (
  SELECT *, row_number() OVER (PARTITION BY file_id, lower(trim(text, ' ')) ORDER BY t, idx) AS r FROM lines WHERE confidence >= 0.5)
WHERE r = 1""")
def first_seen_confident(spark, sf_dir):
    return segments.first_seen(document_lines(spark, sf_dir), min_confidence=0.5).select("file_id", "idx")


# --- batches of frames and their descriptions ------------------------------------------------------------

def frame_rows(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file_id"), (F.col("turn") * 5.0).alias("t"), F.col("turn").alias("idx"), "text",
    )


BATCHES = """rows AS (
  SELECT conv_id AS file_id, turn * 5.0::DOUBLE AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i,
         count(*) OVER (PARTITION BY conv_id) AS n FROM conversations
), b AS (
  SELECT file_id, k // {step} AS batch, least(3, n - k) AS size, k
  FROM (SELECT DISTINCT file_id, n FROM rows), range(0, 1000) r(k) WHERE k < n AND k % {step} = 0)
SELECT b.file_id, b.batch::BIGINT AS batch, (r.i - k)::BIGINT AS pos, r.t, m.t AS batch_t
FROM b JOIN rows r ON r.file_id = b.file_id AND r.i >= k AND r.i < k + 3
       JOIN rows m ON m.file_id = b.file_id AND m.i = k + size // 2 {where}"""


@query("batch_rows", "WITH " + BATCHES.format(step=3, where=""))
def batch_rows(spark, sf_dir):
    out = segments.batch_rows(frame_rows(spark, sf_dir), k=3)
    return out.select("file_id", "batch", F.col("pos").cast("long").alias("pos"), "t", "batch_t")


@query("batch_rows_overlap", "WITH " + BATCHES.format(step=2, where="WHERE size >= 2 OR batch = 0"))
def batch_rows_overlap(spark, sf_dir):
    out = segments.batch_rows(frame_rows(spark, sf_dir), k=3, overlap=True)
    return out.select("file_id", "batch", F.col("pos").cast("long").alias("pos"), "t", "batch_t")


@query("previous_text", """
SELECT conv_id AS file_id, turn AS idx, md5(last_value(d IGNORE NULLS) OVER (
         PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS previous_md5
FROM (SELECT *, CASE WHEN length(text) % 3 <> 0 THEN text END AS d FROM conversations)""")
def previous_text(spark, sf_dir):
    rows = frame_rows(spark, sf_dir).withColumn("d", F.when(F.length("text") % 3 != 0, F.col("text")))
    out = segments.previous_text(rows, ["file_id"], ["t", "idx"], "d")
    return out.select("file_id", "idx", F.md5("previous").alias("previous_md5"))


@query("frame_index", """
SELECT conv_id AS file_id, turn AS idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_index
FROM conversations QUALIFY length(text) % 4 <> 0""")
def frame_index(spark, sf_dir):
    rows = frame_rows(spark, sf_dir)
    out = segments.frame_index(rows, ["file_id"], "t", ok=F.length("text") % 4 != 0)
    return out.select("file_id", "idx", "frame_index")


# --- model responses -------------------------------------------------------------------------------------

def model_responses(spark, sf_dir):
    """Well-formed and damaged answers built from events."""
    # A column of its own, so that the document is read once for each row and not in every use.
    obs = observations(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    k, label = F.col("k"), F.col("label")
    forms = [
        F.format_string('```json\n{"objects": ["%s", {"name": "item %s"}], "action": "a %s", "description": " seen %s ", "change": "new"}\n```', label, k, label, k),
        F.format_string("{'objects': [\"%s\", {'label': 'k%s'}, {\"x\": 1}, 7], 'description': 'value %s', }", label, k, k),
        F.format_string('{"objects": [{"name": "%s"}, {"name": "k%s"}, {"nam', label, k),
        F.format_string('{"objects": ["%s", "color", "k%s"], "description": "half of %s"', label, k, k),
        F.format_string('- %s, k%s\n* other: no\n"last %s",\n', label, k, k),
        F.format_string('[{"objects": ["%s"], "description": "short"}, {"objects": [{"label": "k%s"}], "description": "a longer text %s"}]', label, k, k),
        F.format_string('{"objects": [], "description**: "bold %s %s"}', label, k),
    ]
    response = F.coalesce(*[F.when(F.col("idx") % 7 == i, form) for i, form in enumerate(forms)])
    return obs.select("file_id", "t", "idx", response.alias("response"))


RESPONSES = OBS + r""", resp AS (
  SELECT file_id, idx, [
    '```json' || chr(10) || '{"objects": ["' || label || '", {"name": "item ' || k || '"}], "action": "a ' || label || '", "description": " seen ' || k || ' ", "change": "new"}' || chr(10) || '```',
    '{''objects'': ["' || label || '", {''label'': ''k' || k || '''}, {"x": 1}, 7], ''description'': ''value ' || k || ''', }',
    '{"objects": [{"name": "' || label || '"}, {"name": "k' || k || '"}, {"nam',
    '{"objects": ["' || label || '", "color", "k' || k || '"], "description": "half of ' || k || '"',
    '- ' || label || ', k' || k || chr(10) || '* other: no' || chr(10) || '"last ' || k || '",' || chr(10),
    '[{"objects": ["' || label || '"], "description": "short"}, {"objects": [{"label": "k' || k || '"}], "description": "a longer text ' || k || '"}]',
    '{"objects": [], "description**: "bold ' || label || ' ' || k || '"}'
  ][idx % 7 + 1] AS response
  FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM obs)
), fixed AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(trim(
           replace(replace(response, '```json', ''), '```', ''), ' ' || chr(10) || chr(9) || chr(13)),
           '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\":', '":'), '"\*+:', '":', 'g'), '(\w)\*+:', '\1":', 'g'),
           '''(\w+)''(\s*):', '"\1"\2:', 'g'), ':\s*''([^'']*)''', ': "\1"', 'g'), ',(\s*[\]\}])', '\1', 'g') AS f
  FROM resp
), cut AS (
  SELECT *, CASE WHEN instr(f, '{') > 0 AND instr(f, '}') > 0
                 THEN f[instr(f, '{'):length(f) - instr(reverse(f), '}') + 1] END AS j FROM fixed
), parsed AS (SELECT *, CASE WHEN json_valid(j) THEN j::JSON END AS root FROM cut
), named AS (
  SELECT *, list_filter(list_transform(json_extract(root, '$.objects[*]'), lambda o:
              CASE json_type(o) WHEN 'VARCHAR' THEN o->>'$'
                   WHEN 'OBJECT' THEN coalesce(nullif(o->>'$.name', ''), o->>'$.label') END),
              lambda s: s IS NOT NULL AND length(s) < 100 AND trim(s) <> '') AS objs,
         nullif(concat_ws(' ', nullif(trim(root->>'$.action'), ''), nullif(trim(root->>'$.description'), ''),
                nullif(trim(root->>'$.continues'), ''), 'Change: ' || nullif(trim(root->>'$.change'), '')), '') AS words
  FROM parsed
), traced AS (
  SELECT *, regexp_extract_all(response, '"name"\s*:\s*"([^"]+)"', 1) AS by_name,
         list_filter(regexp_extract_all(regexp_extract(response, '"objects"\s*:\s*\[([^\]]*)', 1), '"([^"]+)"', 1),
                     lambda s: s NOT IN ('name', 'color', 'location')) AS by_list,
         nullif(trim(regexp_extract(response, '"description["\*]*\s*:\s*"([^"]+)"', 1)), '') AS said
  FROM named), plain AS (
  SELECT idx, list_filter(flatten(list_transform(list_filter(list_transform(list_filter(list_transform(
             string_split(response, chr(10)),
             lambda s: trim(trim(trim(trim(s), '-'), '*'))),
             lambda s: s <> '' AND NOT regexp_matches(s, '^[{}]|^```|^"objects"')),
             lambda s: CASE WHEN regexp_matches(s, '^".*"$') AND length(s) > 1 THEN rtrim(s[2:length(s) - 1], ',') ELSE s END),
             lambda s: length(s) <= 50 AND NOT contains(s, '[') AND NOT contains(s, ':')),
             lambda s: list_transform(string_split(s, ','), lambda p: trim(trim(trim(p), '"'), '''')))),
             lambda p: p <> '' AND length(p) < 50) AS lines
  FROM resp)"""


@query("repair_json", "WITH " + RESPONSES + "\nSELECT idx, md5(f) AS fixed_md5 FROM fixed")
def repair_json(spark, sf_dir):
    return model_responses(spark, sf_dir).select("idx", F.md5(responses.repair_json("response")).alias("fixed_md5"))


@query("parse_response", "WITH " + RESPONSES + """
SELECT idx, root IS NOT NULL AS is_parsed, CASE WHEN root IS NOT NULL THEN array_to_string(objs, '|') END AS objects,
       CASE WHEN root IS NOT NULL THEN words END AS description FROM named""")
def parse_response(spark, sf_dir):
    out = responses.parse_response(model_responses(spark, sf_dir))
    return out.select(
        "idx", F.col("answer").isNotNull().alias("is_parsed"), F.array_join("answer.objects", "|").alias("objects"),
        "answer.description",
    )


@query("recover_response", "WITH " + RESPONSES + r"""
SELECT idx, array_to_string(CASE WHEN len(by_name) > 0 THEN by_name WHEN said IS NOT NULL OR len(by_list) > 0 THEN by_list
                ELSE lines END, '|') AS objects,
       CASE WHEN len(by_name) > 0 THEN NULL ELSE said END AS description
FROM traced JOIN plain USING (idx)""")
def recover_response(spark, sf_dir):
    out = responses.recover_response(model_responses(spark, sf_dir))
    return out.select("idx", F.array_join("answer.objects", "|").alias("objects"), "answer.description")


@query("parse_frame_response", "WITH " + RESPONSES + r""", f2 AS (
  SELECT *, instr(f, '[') > 0 AND (instr(f, '{') = 0 OR instr(f, '[') < instr(f, '{')) AS is_array FROM fixed
), f3 AS (
  SELECT *, CASE WHEN is_array THEN f[instr(f, '['):length(f) - instr(reverse(f), ']') + 1]
                 WHEN instr(f, '{') > 0 AND instr(f, '}') > 0 THEN f[instr(f, '{'):length(f) - instr(reverse(f), '}') + 1] END AS body
  FROM f2
), f4 AS (
  SELECT *, CASE WHEN json_valid(body) THEN
              CASE WHEN is_array THEN json_extract(body::JSON, '$[*]') ELSE [body::JSON] END END AS items FROM f3
), f5 AS (
  SELECT *, flatten(list_transform(items, lambda it: list_filter(list_transform(json_extract(it, '$.objects[*]'), lambda o:
              CASE json_type(o) WHEN 'VARCHAR' THEN o->>'$'
                   WHEN 'OBJECT' THEN coalesce(nullif(o->>'$.name', ''), o->>'$.label') END), lambda s: s IS NOT NULL))) AS objs,
         list_filter(list_transform(items, lambda it: it->>'$.description'), lambda d: length(d) > 10)[1] AS words
  FROM f4)
SELECT idx, array_to_string(CASE WHEN items IS NULL THEN lines ELSE objs END, '|') AS objects, trim(words) AS description
FROM f5 JOIN plain USING (idx)""")
def parse_frame_response(spark, sf_dir):
    out = responses.parse_frame_response(model_responses(spark, sf_dir))
    return out.select("idx", F.array_join("answer.objects", "|").alias("objects"), "answer.description")


@query("label_presence", "WITH " + RESPONSES + """
SELECT file_id, lower(trim(o)) AS label, count(*)::BIGINT AS n_named, 1::BIGINT AS present
FROM (SELECT file_id, unnest(CASE WHEN root IS NOT NULL THEN objs WHEN len(by_name) > 0 THEN by_name
                                  WHEN contains(response, '{') THEN by_list ELSE lines END) AS o
      FROM traced JOIN plain USING (idx)) GROUP BY ALL""")
def label_presence(spark, sf_dir):
    read = responses.read_response(model_responses(spark, sf_dir))
    return aggregates.label_presence(responses.named_objects(read, ["file_id"]))


def contexts(spark, sf_dir):
    """Context maps built from documents; an empty language is skipped in the prompt."""
    docs = table(spark, sf_dir, "documents")
    person = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Person "), F.col("doc_id").cast("string"))).otherwise("")
    topic = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return docs.select(
        "doc_id",
        F.create_map(
            F.lit("person"), person, F.lit("language"), F.col("lang"), F.lit("camera_mount"), F.lit("tripod"),
            F.lit("topic"), topic,
        ).alias("context"),
    )


@query("build_prompt", """
SELECT doc_id, 'Known context about this video:' || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN '- Person identified: Person ' || doc_id || chr(10) ELSE '' END
  || '- Language spoken: ' || lang || chr(10) || '- Camera Mount: tripod'
  || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '- Topic/Subject: ' || source ELSE '' END AS context_lines,
  doc_id % 3 = 0 AS has_person_rule, doc_id % 2 = 0 AS has_topic_rule
FROM documents""")
def build_prompt(spark, sf_dir):
    built = contexts(spark, sf_dir).select("doc_id", prompts.build_prompt("context").alias("prompt"))
    head = F.substring_index(F.substring_index("prompt", "\n\nIMPORTANT", 1), "\nLook at this image", 1)
    return built.select(
        "doc_id", F.rtrim(head).alias("context_lines"),
        F.col("prompt").contains("IMPORTANT: The person").alias("has_person_rule"),
        F.col("prompt").contains("This video shows").alias("has_topic_rule"),
    )
