"""Command line: ``python -m tallgrass merge|dedupe|lines|docx|extract|build``.

Exit codes: 0 done or nothing to do, 1 duplicates found by ``dedupe --check``, 2 unusable input.
"""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrass.functions import text as T
from tallgrass.functions.records import LINK_FIELDS, answer_blank, answer_form
from tallgrass.operators import dedupe, extract, merge, rollup
from tallgrass.sources import files, images, sinks


def keyed(records: DataFrame) -> DataFrame:
    return records.drop("path").withColumn("key", T.key("question")).withColumn("form", answer_form(F.col("answer")))


def run_merge(spark: SparkSession, args: argparse.Namespace) -> int:
    base, incoming = (keyed(files.read_records(spark, p)) for p in (args.base, args.incoming))
    given = incoming.filter(F.trim("question") != "")
    plain = ["question", "answer", *LINK_FIELDS]
    texts = lambda df: df.withColumn("answer", F.to_json("answer"))
    merged = merge.ordered_merge(texts(base), texts(given), "key", "ord", "form", LINK_FIELDS)
    report = merge.merge_report(merged).first()
    print(f"added {report.added}, updated {report.updated}, same {report.same}, empty {incoming.count() - given.count()}")
    if args.dry_run or not report.added + report.updated:
        return 0
    place = F.struct(F.col("is_new").cast("int").alias("new"), F.col("pos")).alias("place")
    hidden = texts(merge.superseded(base, "key", "ord")).select(*plain, F.struct(F.lit(0).alias("new"), F.col("ord").alias("pos")).alias("place"))
    rows = merged.select(*plain, place).unionByName(hidden).withColumn("answer", F.parse_json("answer"))
    sinks.write_canonical(spark, rows, "place", args.base)
    return 0


def run_dedupe(spark: SparkSession, args: argparse.Namespace) -> int:
    base = keyed(files.read_records(spark, args.base))
    count = dedupe.surplus(base, "key").first()
    print(f"{count.groups} groups, {count.removed} to remove, {count.stay} stay")
    if not count.removed:
        return 0
    if args.check:
        return 1
    kept = dedupe.dedupe_in_place(base.withColumn("answer", F.to_json("answer")), "key", "ord", LINK_FIELDS)
    sinks.write_canonical(spark, kept.drop("key", "form").withColumn("answer", F.parse_json("answer")), "ord", args.base)
    return 0


def _write_new(spark: SparkSession, records: DataFrame, out: str) -> int:
    rows = keyed(records).filter(~answer_blank(F.col("answer")) & (F.col("key") != ""))
    best = dedupe.dedupe_last(rows.withColumn("answer", F.to_json("answer")), "key", "ord")
    sinks.write_canonical(spark, best.select("question", F.parse_json("answer").alias("answer"), "pos"), "pos", out)
    return 0


def run_lines(spark: SparkSession, args: argparse.Namespace) -> int:
    pairs = extract.marker_records(files.read_lines(spark, args.source), "path", "idx", "text")
    answer = F.when(F.size("answers") == 1, F.parse_json(F.to_json(F.struct(F.col("answers")[0].alias("a")))).cast("variant")).otherwise(None)
    one = F.try_variant_get(answer, "$.a", "variant")
    return _write_new(spark, pairs.select("question", F.coalesce(one, F.parse_json(F.to_json("answers"))).alias("answer"), F.col("pos").alias("ord")), args.out)


def run_docx(spark: SparkSession, args: argparse.Namespace) -> int:
    found = files.highlighted_records(files.read_docx(spark, args.source))
    answer = F.try_variant_get(F.parse_json(F.to_json(F.struct(F.col("answer").alias("a")))), "$.a", "variant")
    return _write_new(spark, found.select("question", answer.alias("answer"), F.col("idx").alias("ord")), args.out)


def run_extract(spark: SparkSession, args: argparse.Namespace) -> int:
    answers = images.answer_pictures(files.read_docx(spark, args.source), files.read_docx_pictures(spark, args.source)).persist()
    for r in rollup.class_histogram(answers, "cls").collect():  # a row for each class
        print(f"{r['class'] or 'unreadable'}: {r.n}")
    crops = images.crop_manifest(answers)
    crops.select("crop", "png").write.mode("overwrite").parquet(f"{args.work}/crops.parquet")
    number = F.struct("i", "k").alias("place")
    sinks.write_canonical(spark, crops.select("i", "k", "cls", "crop", "question", number), "place", f"{args.work}/crops.json")
    sinks.write_canonical(spark, images.pending_manifest(answers).drop("path").withColumn("place", F.col("i")), "place", f"{args.work}/pending.json")
    return 0


def run_build(spark: SparkSession, args: argparse.Namespace) -> int:
    given = files.read_json(spark, f"{args.work}/crops.json", "i INT, k STRING, question STRING")
    skipped = [int(x) for x in re.findall(r"\d+", args.skip_i or "")]
    told = files.read_transcriptions(spark, args.transcribe or f"{args.work}/transcribe.json")
    made = extract.built_records(given, told, skipped).withColumn("answer", F.parse_json("answer")).withColumn("key", T.key("question"))
    rows = made.filter(~answer_blank(F.col("answer")) & (F.col("key") != "")).withColumn("answer", F.to_json("answer"))
    fresh = dedupe.dedupe_last(rows, "key", "place").select("key", "question", "answer", *[F.lit(None).cast("string").alias(c) for c in LINK_FIELDS], F.struct(F.lit(1).alias("new"), F.lit(0).cast("long").alias("ord"), F.col("pos")).alias("place"))
    print(f"{made.count()} records, {fresh.count()} different questions")
    if args.merge:
        base = keyed(files.read_records(spark, args.merge)).withColumn("answer", F.to_json("answer"))
        nowhere = F.lit(None).cast(fresh.schema["place"].dataType["pos"].dataType)
        base = base.select("key", "question", "answer", *LINK_FIELDS, F.struct(F.lit(0).alias("new"), F.col("ord").cast("long").alias("ord"), nowhere.alias("pos")).alias("place"))
        if args.refresh:
            now = fresh.select("key", F.struct("question", "answer", *LINK_FIELDS).alias("now"))
            base = base.join(now, "key", "left").select("key", *[F.when(F.col("now").isNull(), F.col(c)).otherwise(F.col(f"now.{c}")).alias(c) for c in ("question", "answer", *LINK_FIELDS)], "place")
        fresh = merge.append_new(base, fresh, "key")
    sinks.write_canonical(spark, fresh.select("question", F.parse_json("answer").alias("answer"), *LINK_FIELDS, "place"), "place", args.out)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallgrass", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for name, run, names in (("merge", run_merge, ("base", "incoming")), ("dedupe", run_dedupe, ("base",)), ("lines", run_lines, ("source", "out")), ("docx", run_docx, ("source", "out")), ("extract", run_extract, ("source", "work")), ("build", run_build, ("work", "out"))):
        sub = commands.add_parser(name)
        for n in names:
            sub.add_argument(n)
        if name == "merge":
            sub.add_argument("--dry-run", action="store_true")
        if name == "dedupe":
            sub.add_argument("--check", action="store_true")
        if name == "build":
            for option in ("--transcribe", "--merge", "--skip-i"):
                sub.add_argument(option)
            sub.add_argument("--refresh", action="store_true")
        sub.set_defaults(run=run)
    args = parser.parse_args(argv)
    try:
        return args.run(spark or SparkSession.builder.appName("tallgrass").getOrCreate(), args)
    except PySparkException as error:
        print(str(error).splitlines()[0], file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
