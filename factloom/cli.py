"""`python -m factloom.cli COMMAND ...`: thin commands over the operators."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from factloom.session import session
from factloom.sources import rule_packs


def rule_frames(spark, rules: str, parser: argparse.ArgumentParser) -> list:
    """Sources, sinks and sanitizers of rule packs, comma-separated."""
    pack = rule_packs.read(*rules.split(","))
    frames = [pack.frame(spark, role) if getattr(pack, role) else None for role in ("sources", "sinks", "sanitizers")]
    if frames[0] is None or frames[1] is None:
        parser.error("the rules have no source or no sink")
    return frames


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="factloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in (("dependencies", ()), ("scan", ("advisories",)), ("malware", ()), ("python-facts", ()), ("taint", ("rules",)), ("class-taint", ("rules",)), ("class-facts", ()), ("rpm", ()), ("text-rules", ("rules",)), ("check-rules", ())):
        c = commands.add_parser(name)
        if name != "check-rules":
            c.add_argument("folder")
        for x in extra:
            c.add_argument(x)
        c.add_argument("out", help="rule packs, comma-separated" if name == "check-rules" else None)
    a = parser.parse_args(args)
    if a.command == "check-rules":
        pack = rule_packs.read(*a.out.split(","))
        for rule, problem in pack.skipped:
            print(f"{rule}: {problem}")
        print(f"{len(pack.sources)} sources, {len(pack.sinks)} sinks, {len(pack.sanitizers)} sanitizers, {len({r['rule'] for r in pack.texts})} text rules, {len(pack.skipped)} left out")
        return
    spark = session()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.folder).select("path", F.col("content").cast("string").alias("content"))
    if a.command in ("dependencies", "scan"):
        from factloom.operators import advisories
        from factloom.sources import manifests

        found = manifests.manifests(files)
        deps = found.where("warning is null").select("ecosystem", "name", "version", "manifest_path", "direct")
        if a.command == "scan":
            known, _ = manifests.advisories(spark, a.advisories)
            advisories.findings(deps, known).write.mode("overwrite").json(f"{a.out}/findings")
            advisories.warnings(deps, known).write.mode("overwrite").json(f"{a.out}/warnings")
        else:
            found.write.mode("overwrite").json(a.out)
    elif a.command == "malware":
        from factloom.operators import text_rules

        text_rules.malware(files).write.mode("overwrite").json(a.out)
    elif a.command == "text-rules":
        from factloom.sources import manifests

        source = manifests.by_language(files)
        rule_packs.scan_texts(source, rule_packs.read(*a.rules.split(","))).write.mode("overwrite").json(a.out)
    elif a.command in ("class-taint", "class-facts", "rpm"):
        from factloom.plans import class_scan
        from factloom.sources import archives, class_files, rpm

        held = archives.extract(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(a.folder).select("path", "content")).where("problem is null")
        if a.command == "rpm":
            rpm.packages(held).write.mode("overwrite").json(a.out)
        elif a.command == "class-facts":
            class_files.decoded(held).write.mode("overwrite").parquet(a.out)
        else:
            class_scan.scan(held, *rule_frames(spark, a.rules, parser)).write.mode("overwrite").json(a.out)
    else:
        from factloom.operators import heap
        from factloom.plans import taint_scan
        from factloom.sources import manifests, python_code

        source = manifests.source_files(spark, a.folder, ["python"]).select("path", "content")
        source = source.join(heap.catalog(source, "path"), "path").select(F.col("object").alias("file_id"), "path", "content")  # numbered, so no two share one
        if a.command == "taint":
            taint_scan.scan(source, *rule_frames(spark, a.rules, parser)).write.mode("overwrite").json(a.out)
        else:
            python_code.facts(source).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
