"""Benchmark reports over labelled timelines, load tests and soak runs.

Turns are (file, start, end, speaker) in seconds; words carry their own start, end and label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import clipped, overlap_join, shared_seconds

#: Labelled words of a speaker in a bin that make a majority, share of the CPUs above which the load is high, memory a run needs in MB.
BIN_WORDS, LOAD_SHARE, MEMORY_MB = 5, 0.75, 3072
HORIZON = 4e9


def survey(turns: DataFrame) -> DataFrame:
    """Per file: speakers, length and speech, to a tenth of a second."""
    return turns.groupBy("file").agg(
        F.count_distinct("speaker").alias("speakers"), F.round(F.max("end"), 1).alias("duration"), F.round(F.sum(F.col("end") - F.col("start")), 1).alias("speech")
    )


def chosen_files(rows: DataFrame, least: float, upto: int) -> DataFrame:
    """For every number of speakers the longest file of ``least`` seconds or more; of equals the first by name."""
    good = rows.where((F.col("speakers") <= upto) & (F.col("duration") >= least))
    return good.groupBy("speakers").agg(F.min_by("file", F.struct(-F.col("duration"), "file")).alias("file"))


def candidate_windows(files: DataFrame, length: float, step: float) -> DataFrame:
    """Sliding windows [start, start + length) that end within a file's duration."""
    last = F.floor((F.col("duration") - length) / step).cast("int")
    out = files.where(F.col("duration") >= length).withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
    return out.select("file", (F.col("_k") * F.lit(step)).alias("start"), (F.col("_k") * F.lit(step) + length).alias("end"))


def speech_per_speaker(turns: DataFrame, windows: DataFrame, width: float = 60.0) -> DataFrame:
    """Seconds of each speaker in each window of the file."""
    pairs = overlap_join(windows, turns, ["file"], width, HORIZON)
    return pairs.groupBy("file", F.col("l_start").alias("start"), F.col("r_speaker").alias("speaker")).agg(F.sum(shared_seconds(pairs)).alias("seconds"))


def speakers_in(turns: DataFrame, start: Column, end: Column, least: float = 0.0) -> DataFrame:
    """Speakers of each file with ``least`` seconds or more inside [start, end); any speech where that is 0."""
    n = clipped(turns, start, end).groupBy("file", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("s"))
    return n.where(F.col("s") >= least).groupBy("file").agg(F.count("*").alias("speakers"))


def majority_labels(reference: DataFrame, hypothesis: DataFrame, start: Column, end: Column, width: float = 60.0) -> DataFrame:
    """Per file and reference speaker the label that covers most of their speech in [start, end); null without one."""
    ref = clipped(reference, start, end)
    pairs = overlap_join(ref, clipped(hypothesis, start, end), ["file"], width, HORIZON)
    n = pairs.groupBy("file", F.col("l_speaker").alias("speaker"), F.col("r_speaker").alias("label")).agg(F.sum(shared_seconds(pairs)).alias("s"))
    top = n.groupBy("file", "speaker").agg(F.min_by("label", F.struct(-F.col("s"), "label")).alias("label"))
    return ref.select("file", "speaker").distinct().join(top, ["file", "speaker"], "left")


def reference_at(words: DataFrame, turns: DataFrame, width: float = 60.0) -> DataFrame:
    """Each word (file, uid, start, end) with the reference speaker whose one turn overlaps it most, the earliest of equals."""
    pairs = overlap_join(words, turns, ["file"], width, HORIZON)
    place = F.struct(-shared_seconds(pairs), "r_start", "r_end", "r_speaker")
    return pairs.groupBy("file", F.col("l_uid").alias("uid")).agg(F.min_by("r_speaker", place).alias("reference"))


def drift_majorities(heard: DataFrame, seconds: float, streamed: float) -> tuple[DataFrame, DataFrame]:
    """(majorities, totals) of words with their reference speaker: per bin and reference the label of most labelled words, five at
    least, with the one before and whether it changed; and per bin the words with and without a label."""
    cell = F.least(F.floor((F.col("start") + F.col("end")) / 2 / seconds), F.lit(int(streamed // seconds))).cast("long")
    heard = heard.where(F.col("end") <= streamed).withColumn("bin", cell)
    totals = heard.groupBy("file", "bin").agg(F.count("label").alias("labelled"), F.count_if(F.col("label").isNull()).alias("unlabelled"))
    n = heard.where("label is not null").groupBy("file", "reference", "bin", "label").agg(F.count("*").alias("n"))
    top = n.groupBy("file", "reference", "bin").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), F.sum("n").alias("words"))
    top = top.where(F.col("words") >= BIN_WORDS)
    top = top.withColumn("before", F.lag("label").over(Window.partitionBy("file", "reference").orderBy("bin")))
    return top.withColumn("swapped", F.coalesce(F.col("before") != F.col("label"), F.lit(False))), totals


def drift_bins(words: DataFrame, turns: DataFrame, seconds: float, streamed: float, width: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """``drift_majorities`` of words whose reference speakers are looked up in the turns; words outside all turns do not count."""
    return drift_majorities(words.join(reference_at(words, turns, width), ["file", "uid"]), seconds, streamed)


def overlap_fractions(clusters: DataFrame, previous: DataFrame, keys: list[str], width: float = 60.0) -> DataFrame:
    """Per raw cluster and label of the previous run: the part of the cluster inside that run's span that the label covered, 1 at most.

    ``clusters`` has start, end, raw; ``previous`` start, end, label.
    """
    span = previous.groupBy(*keys).agg(F.min("start").alias("_a"), F.max("end").alias("_b"))
    inside = clusters.join(span, keys).groupBy(*keys, "raw").agg(
        F.sum(F.greatest(F.lit(0.0), F.least("end", "_b") - F.greatest("start", "_a"))).alias("inside")
    )
    pairs = overlap_join(clusters, previous, keys, width, HORIZON)
    votes = pairs.groupBy(*keys, F.col("l_raw").alias("raw"), F.col("r_label").alias("label")).agg(F.sum(shared_seconds(pairs)).alias("s"))
    joined = votes.join(inside.where("inside > 0"), [*keys, "raw"])
    return joined.select(*keys, "raw", "label", F.least(F.lit(1.0), F.col("s") / F.col("inside")).alias("fraction"))


def raw_clusters(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (start, end, raw) by raw label: duration, first start, and their number."""
    return segments.groupBy(*keys, "raw").agg(
        F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("duration"), F.min("start").alias("first_start"), F.count("*").alias("segments")
    )


def seniority(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters numbered in order of first appearance, equals by name."""
    return clusters.withColumn("speaker", F.row_number().over(Window.partitionBy(*keys).orderBy("first_start", "raw")) - 1)


def chunks_before(ledger: DataFrame, keys: list[str], until: Column) -> DataFrame:
    """Ids of the ledger's chunks that start before an instant, in order."""
    hit = ledger.where(F.col("start") < until).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "chunk"))).alias("c"))
    return hit.select(*keys, F.transform("c", lambda x: x["chunk"]).alias("chunks"))


def normalised(errors: DataFrame) -> DataFrame:
    """missed, false_alarm and confusion as shares of the reference speech (of one second where there is none), with their sum."""
    base = F.when(F.col("total") == 0, 1.0).otherwise(F.col("total"))
    parts = ("missed", "false_alarm", "confusion")
    share = {c: F.round(F.col(c) / base, 4) for c in parts}
    return errors.withColumn("value", F.round(sum((F.col(c) for c in parts), F.lit(0.0)) / base, 4)).withColumns(share)


def count_report(files: DataFrame) -> DataFrame:
    """One row over files (speaking, used, minted, settled): how far the number of labels is from that of speakers."""
    error, base = F.col("used") - F.col("speaking"), F.greatest(F.lit(1), F.col("speaking"))
    settled = F.abs(F.col("settled") - F.col("speaking"))
    mean = lambda c: F.round(F.avg(c.cast("double")), 3)
    return files.agg(
        mean(F.abs(error)).alias("count_error"), mean(F.abs(error) <= 1).alias("within_one"), mean(error == 0).alias("exact"), mean(error).alias("signed_error"),
        mean(F.col("minted") / base).alias("minted_per_speaker"), mean(F.col("settled") / base).alias("settled_per_speaker"),
        mean(settled <= 1).alias("settled_within_one"), mean(settled == 0).alias("settled_exact"),
    )


def jaccard_error(shared: DataFrame) -> DataFrame:
    """Per file: mean over reference speakers of 1 - overlap / union with the label mapped to them; 1 without one.

    ``shared`` has file, speaker, overlap, own (seconds of the speaker) and other (seconds of the label, 0 without one).
    """
    union = F.col("own") + F.col("other") - F.col("overlap")
    return shared.groupBy("file").agg(F.avg(1 - F.coalesce(F.try_divide("overlap", union), F.lit(0.0))).alias("jer"))


def questions(turns: DataFrame, asked: DataFrame, width: float = 60.0) -> DataFrame:
    """Verdict of every question (file, uid, start, end): own, instructor or unlabelled, with the seconds given to the instructor.

    The instructor's label is that of most of the time outside all questions.
    """
    pairs = overlap_join(asked, turns, ["file"], width, HORIZON)
    seen = pairs.groupBy("file", F.col("l_uid").alias("uid"), F.col("r_speaker").alias("label")).agg(F.sum(shared_seconds(pairs)).alias("s"))
    told = turns.groupBy("file", F.col("speaker").alias("label")).agg(F.sum(F.col("end") - F.col("start")).alias("t"))
    lecture = told.join(seen.groupBy("file", "label").agg(F.sum("s").alias("q")), ["file", "label"], "left").withColumn("rest", F.col("t") - F.coalesce("q", F.lit(0.0)))
    instructor = lecture.where("rest > 1e-9").groupBy("file").agg(F.min_by("label", F.struct(-F.col("rest"), "label")).alias("instructor"))
    top = seen.groupBy("file", "uid").agg(F.min_by("label", F.struct(-F.col("s"), "label")).alias("label"))
    out = asked.select("file", "uid").join(top, ["file", "uid"], "left").join(instructor, "file", "left")
    own = seen.join(instructor, (seen["file"] == instructor["file"]) & (F.col("label") == F.col("instructor"))).select(seen["file"], "uid", F.col("s").alias("as_instructor"))
    out = out.join(own, ["file", "uid"], "left").withColumn("as_instructor", F.coalesce("as_instructor", F.lit(0.0)))
    verdict = F.when(F.col("label").isNull(), "unlabelled").when(F.col("label") == F.col("instructor"), "instructor").otherwise("own")
    return out.select("file", "uid", "label", verdict.alias("verdict"), "as_instructor")


def recovery(arrivals: DataFrame, labels: DataFrame, killed: DataFrame) -> DataFrame:
    """Per run: seconds from the kill to the next caption, to the next label and to the first label on later audio, and the gap around it.

    ``killed`` has run, at and stream_at; ``arrivals`` run and at; ``labels`` run, at and audio_end.
    """
    k = killed.withColumnsRenamed({"at": "killed_at"})
    a = arrivals.join(k, "run").groupBy("run").agg(
        F.min(F.when(F.col("at") > F.col("killed_at"), F.col("at"))).alias("_next"), F.max(F.when(F.col("at") <= F.col("killed_at"), F.col("at"))).alias("_last")
    )
    late = F.col("at") > F.col("killed_at")
    l = labels.join(k, "run").groupBy("run").agg(
        F.min(F.when(late, F.col("at") - F.col("killed_at"))).alias("labels_after"),
        F.min(F.when(late & (F.col("audio_end") >= F.col("stream_at")), F.col("at") - F.col("killed_at"))).alias("new_audio_after"),
        F.count_if(late).alias("labels_since"),
    )
    out = k.join(a, "run", "left").join(l, "run", "left")
    return out.select("run", F.round(F.col("_next") - F.col("killed_at"), 2).alias("captions_after"), F.round(F.col("_next") - F.col("_last"), 2).alias("gap"),
                      F.round("labels_after", 2).alias("labels_after"), F.round("new_audio_after", 2).alias("new_audio_after"), F.coalesce("labels_since", F.lit(0)).alias("labels_since"))


def counter_summary(series: DataFrame, names: list[str]) -> DataFrame:
    """Sum of all series of each counter of interest; absent ones are 0."""
    wanted = series.sparkSession.createDataFrame([(n,) for n in names], "name string")
    n = series.groupBy("name").agg(F.sum("value").alias("v"))
    return F.broadcast(wanted).join(n, "name", "left").select("name", F.round(F.coalesce("v", F.lit(0.0)), 3).alias("total"))


def busiest_histogram(series: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """Of each histogram of interest the series with the largest count, the first of equals by its labels."""
    hit = series.where(F.col("name").isin(names))
    return hit.groupBy("name").agg(F.min_by(F.struct(*values), F.struct(-F.col("count"), "labels")).alias("_b")).select("name", "_b.*")


def pooled(runs: list[DataFrame], value: str) -> DataFrame:
    """Samples of all runs in one frame, for one summary of them."""
    out = runs[0].select(value)
    for r in runs[1:]:
        out = out.unionByName(r.select(value))
    return out


def load_summary(sessions: DataFrame, cpu: DataFrame) -> DataFrame:
    """One row of a load test: rates per 1000 chunks, CPU, failed sessions. ``sessions`` has chunks, messages, finals, words, errors."""
    rate = lambda c: F.round(F.try_divide(F.sum(c), F.sum("chunks")) * 1000, 1)
    s = sessions.agg(
        F.count("*").alias("sessions"), F.sum("chunks").alias("chunks"), F.sum("messages").alias("messages"), F.sum("finals").alias("finals"), F.sum("words").alias("words"),
        rate("messages").alias("transcripts_per_1000"), rate("words").alias("words_per_1000"), F.count_if((F.col("errors") > 0) | (F.col("messages") == 0)).alias("failures"),
    )
    c = cpu.agg(F.avg("percent").alias("_m"), F.max("percent").alias("cpu_max"))
    both = s.crossJoin(c)  # one row each
    return both.select("*", F.round("_m", 1).alias("cpu_mean"), F.round(F.col("_m") / 100 / F.col("sessions"), 2).alias("cores_per_session"), (F.col("failures") == 0).alias("ok")).drop("_m")


def hygiene(machines: DataFrame) -> DataFrame:
    """What may spoil a run on each machine (swap_mb, load, cpus, free_mb), and whether nothing does."""
    warn = F.array_compact(F.array(
        F.when(F.col("swap_mb") > 0, "swap"), F.when(F.col("load") > F.col("cpus") * LOAD_SHARE, "load"), F.when(F.col("free_mb") < MEMORY_MB, "memory")
    ))
    return machines.withColumn("warnings", warn).withColumn("clean", F.size("warnings") == 0)


def acceptance(targets: DataFrame, metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """PASS, MISSED or SKIPPED of every target.

    ``targets`` has name, metric and one rule: max, min, both (a band), relative_to with ratio and plus, or vs_baseline with slack.
    ``metrics`` and ``baseline`` have metric and value; a rule whose value is missing is skipped.
    """
    look = lambda df, key, name: df.select(F.col("metric").alias(key), F.col("value").alias(name))
    t = targets.join(F.broadcast(metrics), "metric", "left")  # a row a metric of one report
    t = t.join(F.broadcast(look(metrics, "relative_to", "_other")), "relative_to", "left").join(F.broadcast(look(baseline, "vs_baseline", "_base")), "vs_baseline", "left")
    limit = (
        F.when(F.col("max").isNotNull(), F.col("max")).when(F.col("min").isNotNull(), F.col("min"))
        .when(F.col("relative_to").isNotNull(), F.col("_other") * F.coalesce("ratio", F.lit(1.0)) + F.coalesce("plus", F.lit(0.0)))
        .when(F.col("vs_baseline").isNotNull(), F.col("_base") + F.coalesce("slack", F.lit(0.0)))
    )
    v = F.col("value")
    fits = (
        F.when(F.col("max").isNotNull() & F.col("min").isNotNull(), v.between(F.col("min"), F.col("max")))
        .when(F.col("max").isNull() & F.col("min").isNotNull(), v >= F.col("min")).otherwise(v <= limit)
    )
    return t.select("name", "value", limit.alias("limit"), F.when(fits.isNull(), "SKIPPED").when(fits, "PASS").otherwise("MISSED").alias("status"))
