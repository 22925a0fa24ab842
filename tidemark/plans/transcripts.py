"""Transcript queries on conversations (a role is a speaker, a turn the order), documents and benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import captions, transcript
from tidemark.plans.register import Registry, table

registry = Registry()
_STOP = ", ".join(f"'{w}'" for w in transcript.STOP_WORDS)
_WORDS = f"list_filter(regexp_split_to_array(regexp_replace(lower({{t}}), '[''’]', '', 'g'), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({_STOP}))"


@registry.query(f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, round(CASE WHEN len(w) > 0 THEN 1 - len(list_distinct(w)) / len(w) ELSE 0 END, 6) AS repetition FROM (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents)")
def repetition_ratio(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", transcript.normalized_words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.round(transcript.repetition(F.col("w")), 6).alias("repetition"))


@registry.query(f"""WITH p AS (SELECT b.item_id, {_WORDS.format(t='b.text')} AS e, {_WORDS.format(t='d.text')} AS a FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
    q AS (SELECT item_id, list_distinct(e) AS e, list_distinct(a) AS a FROM p), r AS (SELECT item_id, CASE WHEN len(e) > 0 THEN len(list_intersect(e, a)) / len(e) ELSE 0 END AS recall, CASE WHEN len(a) > 0 THEN len(list_intersect(e, a)) / len(a) ELSE 0 END AS precision, len(e) - len(list_intersect(e, a)) AS missing FROM q)
    SELECT item_id, round(recall, 6) AS recall, round(precision, 6) AS precision, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0 END, 6) AS f1, missing FROM r""")
def transcript_accuracy(spark, sf_dir):
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("said"))
    j = b.join(d, F.col("doc_id") == F.col("item_id"))
    s = j.select("item_id", transcript.accuracy(transcript.normalized_words(F.col("text")), transcript.normalized_words(F.col("said"))).alias("s"))
    r = lambda c: F.round(f"s.{c}", 6).alias(c)
    return s.select("item_id", r("recall"), r("precision"), r("f1"), F.size("s.missing").cast("long").alias("missing"))


@registry.query(r"SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", transcript.word_count(F.col("text")).cast("long").alias("words"))


@registry.query("""WITH r AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM r)
    SELECT conv_id, run::BIGINT AS run, any_value(role) AS speaker, string_agg(text, ' ' ORDER BY turn, text) AS text, min(turn) AS first, max(turn) AS last FROM i GROUP BY conv_id, run""")
def speaker_runs(spark, sf_dir):
    return transcript.speaker_runs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", "text")


@registry.query("""WITH n AS (SELECT conv_id, role, count(*) AS n, min(turn) AS o FROM conversations WHERE role IS NOT NULL GROUP BY ALL) SELECT conv_id, arg_max(role, (n, -o)) AS dominant, max(n) AS times FROM n GROUP BY conv_id""")
def dominant_speaker(spark, sf_dir):
    return transcript.dominant(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


@registry.query("SELECT conv_id, arg_max(role, turn) AS last_speaker FROM conversations WHERE role IS NOT NULL GROUP BY conv_id")
def last_attributed_speaker(spark, sf_dir):
    return transcript.last_attributed(table(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


@registry.query("""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda w: w <> '') AS w FROM conversations),
    g AS (SELECT conv_id, turn, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS t FROM w),
    l AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM g)
    SELECT conv_id, turn, coalesce(len(list_intersect(t, b)) / len(list_distinct(list_concat(t, b))) > 0.7, false) AS repeats FROM l""".replace("\\\\", "\\"))
def repeats_previous_segment(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return transcript.repeats_previous(c, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "repeats")


@registry.query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def transcript_paragraphs(spark, sf_dir):
    return transcript.paragraphs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")


@registry.query("""WITH r AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM r),
    g AS (SELECT conv_id, run, any_value(role) AS speaker, string_agg(text, ' ' ORDER BY turn, text) AS text FROM i GROUP BY conv_id, run)
    SELECT conv_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY run) AS text FROM g GROUP BY conv_id""")
def rendered_transcript(spark, sf_dir):
    return transcript.rendered(speaker_runs(spark, sf_dir), ["conv_id"])


@registry.query("SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN 'Speaker ' || (n_nationkey + 1) ELSE n_name END AS name FROM nation")
def speaker_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    raw = F.when(F.col("n_nationkey") < 20, F.concat(F.lit("spk_"), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name"))
    return n.select("n_nationkey", transcript.display_name(raw).alias("name"))


@registry.query("""SELECT conv_id, string_agg(coalesce(CASE WHEN turn % 3 = 0 THEN role END, 'late_' || turn), ',' ORDER BY turn) AS labels, count(*) FILTER (turn % 3 <> 0) > 0 AS awaited FROM conversations GROUP BY conv_id""")
def late_label_merge(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    known = F.when(F.col("turn") % 3 == 0, F.col("role"))
    cells = F.sort_array(F.collect_list(F.struct("turn", known.alias("a"), F.concat(F.lit("late_"), F.col("turn")).alias("b"))))
    g = c.groupBy("conv_id").agg(cells.alias("c"))
    a, b = F.transform("c", lambda x: x["a"]), F.transform("c", lambda x: x["b"])
    return g.select("conv_id", F.array_join(transcript.merged_labels(a, b), ",").alias("labels"), transcript.awaiting(a).alias("awaited"))


@registry.query()
def text_chunks(spark, sf_dir):
    """Chunks at paragraph, sentence and word ends: each cut depends on the one before; tested on examples."""
    return transcript.chunked(table(spark, sf_dir, "documents"), "doc_id", "text", 2000)


@registry.query("""SELECT CASE WHEN toxic = 1 THEN 'flagged' WHEN quality = 1 THEN 'own' ELSE 'unlabelled' END AS verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM labels GROUP BY 1""")
def verdict_fractions(spark, sf_dir):
    v = F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "own").otherwise("unlabelled")
    n = table(spark, sf_dir, "labels").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    every = Window.partitionBy(F.lit(1))  # three rows
    return n.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(every), 6))


def spoken_drafts(spark, sf_dir):
    """Conversations as growing drafts: at each turn all words so far, half a second each."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    word = c.select("conv_id", "turn", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("i", "word"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "i"))
    word = word.withColumn("p", place.cast("double"))
    turns = c.select("conv_id", F.col("turn").alias("seq"))
    so_far = turns.join(word, "conv_id").where("turn <= seq").groupBy("conv_id", "seq")
    text = F.struct(F.col("p"), F.concat(F.lit(" "), F.col("word")).alias("text"), F.col("p").alias("start"), (F.col("p") + 0.5).alias("end"))
    words = F.transform(F.sort_array(F.collect_list(text)), lambda w: F.struct(w["text"], w["start"], w["end"]))
    return so_far.agg(words.alias("words")).select(F.col("conv_id").alias("session"), F.col("seq").cast("long").alias("seq"), "words", F.lit(None).cast("double").alias("full_until"))


@registry.query(r"""WITH w AS (SELECT conv_id, turn, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS p FROM (SELECT conv_id, turn, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS l FROM conversations WHERE text IS NOT NULL))),
    n AS (SELECT conv_id, turn, max(p) AS upto FROM w GROUP BY ALL),
    a AS (SELECT *, lag(upto, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS agreed FROM n),
    f AS (SELECT a.conv_id, a.turn, a.upto, a.agreed, coalesce(max(p) FILTER (regexp_matches(w, '[.?!]$') AND NOT w LIKE '%...'), 0) AS done FROM a LEFT JOIN w ON w.conv_id = a.conv_id AND p <= a.agreed GROUP BY ALL),
    g AS (SELECT *, lag(done, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM f)
    SELECT g.conv_id AS session, g.turn::BIGINT AS seq, string_agg(' ' || w, '' ORDER BY p) FILTER (p > before AND p <= done) AS final, max(p + 0.5) FILTER (p > before AND p <= done)::DOUBLE AS final_end,
      string_agg(' ' || w, '' ORDER BY p) FILTER (p > done) AS in_progress, false AS forced FROM g JOIN w ON w.conv_id = g.conv_id AND p <= g.upto GROUP BY ALL""")
def caption_steps(spark, sf_dir):
    """What clients are told as a conversation grows: sentences that two drafts agree on are final."""
    return captions.caption_steps(spoken_drafts(spark, sf_dir))
