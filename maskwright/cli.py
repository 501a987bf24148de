"""Redact Word files or text tables from the command line."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwright.operators import spans
from maskwright.operators.policies import POLICIES
from maskwright.operators.recognizers import REGISTRY
from maskwright.plans import redact as plans
from maskwright.sources import annotations, docx


def listed(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    p.add_argument("source", help="a .docx file, a folder of them, or a Parquet table with doc_id and text")
    p.add_argument("-o", "--output", help="folder for the results, by default <source>.redacted; a name that ends in .docx, if the source is one such file, is written as that file")
    p.add_argument("-t", "--transform", choices=["redact", "passthrough"], default="redact")
    p.add_argument("-p", "--policy", choices=sorted(POLICIES), default="fake")
    p.add_argument("--mapping", help="folder for the mapping, which undoes the redaction, as JSON lines; a name that ends in .json is written as one array")
    p.add_argument("--only", help="comma-separated recognizers")
    p.add_argument("--exclude", help="comma-separated recognizers to leave out")
    p.add_argument("--no-headers", action="store_true", help="leave headers and footers alone")
    p.add_argument("--single-pass", action="store_true", help="do not look again for the names that were found")
    p.add_argument("--dry-run", action="store_true", help="report only")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("maskwright").getOrCreate()
    if "://" not in a.source and not os.path.exists(a.source):
        print(f"no such file: {a.source}", file=sys.stderr)
        return 1
    try:
        REGISTRY.build(listed(a.only), listed(a.exclude))
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 1
    if (a.output or "").endswith(".docx") and not a.source.endswith(".docx"):
        print("one .docx can only be written from one .docx", file=sys.stderr)
        return 1
    word = not a.source.rstrip("/").endswith(".parquet")
    files = docx.load(spark, a.source) if word else None
    blocks = docx.blocks(files, not a.no_headers) if word else plans.blocks_of(spark.read.parquet(a.source))
    options = {"policy_name": a.policy, "passes": 1 if a.single_pass else 2, "only": listed(a.only), "exclude": listed(a.exclude)}
    done, mapping = plans.transform(a.transform, blocks, **options)
    done = done.persist()
    try:
        stats = plans.statistics(done).first()
        print(f"{stats.blocks} blocks, {stats.non_empty_blocks} not blank, {stats.characters} characters, {stats.replacements} replacements")
        if word:
            for row in docx.scanned(files).filter("reason != 'kept'").groupBy("reason").agg(F.sum("runs").alias("n")).orderBy("reason").collect():  # a row for each reason
                print(f"  not read, {row.reason}: {row.n} runs")
        for row in plans.by_label(done).orderBy(F.desc("n"), "label").collect():  # a row for each label
            print(f"  {row.label}: {row.n}")
        if a.mapping:
            rows = annotations.mapping_json(mapping) if mapping is not None else spark.createDataFrame([], "value string")
            if a.mapping.endswith(".json"):
                with open(a.mapping, "w", encoding="utf-8") as f:  # one array, a partition of it in memory at a time
                    f.write("[")
                    for k, row in enumerate(rows.toLocalIterator()):
                        f.write((",\n" if k else "") + row.value)
                    f.write("]\n")
            else:
                rows.write.mode("overwrite").text(a.mapping)
        if not a.dry_run:
            out = a.output or f"{a.source.rstrip('/')}.redacted"
            if word:
                changed = done.withColumn("new_runs", spans.splice_runs(F.col("runs"), F.col("landed")))
                saved = docx.save(files, changed)
                if out.endswith(".docx"):
                    (one,) = saved.collect()  # the one file that was read
                    errors = [one] if one.error else []
                    if not errors:
                        with open(out, "wb") as f:
                            f.write(bytes(one.content))
                else:
                    saved.write.mode("overwrite").parquet(out)
                    errors = spark.read.parquet(out).filter("error is not null").select("doc_id", "error").limit(20).collect()  # named, not counted
                for row in errors:
                    print(f"not written: {row.doc_id}: {row.error}", file=sys.stderr)
                if errors:
                    return 1
            else:
                plans.joined_up(done).write.mode("overwrite").parquet(out)
    finally:
        done.unpersist()
    return 0


if __name__ == "__main__":
    sys.exit(main())
