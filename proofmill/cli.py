"""Command line: version, diagnose, ingest, health, vault-plan, vault-adapt."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from proofmill.config import Settings

VERSION = "0.1.0"


def session() -> SparkSession:
    return SparkSession.builder.appName("proofmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _ingest(args) -> int:
    from proofmill.sources import files, manifest

    spark = session()
    known = manifest.load(spark, Path(args.manifest).resolve().as_uri()) if os.path.exists(args.manifest) else spark.createDataFrame([], manifest.ENTRY)
    if not os.path.exists(args.path):
        print(f"error: {args.path} does not exist", file=sys.stderr)
        return 1
    rows = files.ingest(spark, args.path, known).cache()
    text = manifest.to_json(manifest.upsert(known, rows.where("status in ('new', 'changed', 'unchanged')")))
    Path(args.manifest).parent.mkdir(parents=True, exist_ok=True)
    Path(args.manifest).write_text(text, encoding="utf-8")
    counts = manifest.summary(rows).first().asDict()
    results = [r.asDict() for r in rows.select("source_path", "document_id", "status").orderBy("source_path").collect()]
    print(json.dumps({**counts, "results": results}, indent=2) if args.json else "\n".join(f"{k}: {v}" for k, v in counts.items()))
    return 1 if counts["error_files"] else 0


def _health(args) -> int:
    from proofmill.operators import health, vault
    from proofmill.sources import manifest

    spark = session()
    single = os.path.isfile(args.path)
    folder = os.path.dirname(args.path) if single else args.path
    files = vault.note_files(spark, folder)
    files = files.where(files.file_path == str(Path(args.path).resolve())) if single else files
    hashes, problem = manifest.source_hashes(spark, Path(args.source_manifest).read_text(encoding="utf-8")) if args.source_manifest else (None, None)
    issues = health.lint(files, hashes, directory=not single, yaml=True)
    if problem:
        issues = issues.unionByName(health.unrecognized(spark, args.source_manifest, problem))
    found = json.loads(health.report_json(files, issues, args.path))
    if args.json:
        print(json.dumps(found, indent=2, ensure_ascii=False))
    else:
        print(health.report_text(found))
    return 0 if found["passed"] else 1


def _vault(args) -> int:
    from pyspark.sql import functions as F

    from proofmill.operators import vault

    spark, config = session(), vault.VaultConfig(allow_overwrite=args.overwrite, allow_unhealthy=args.allow_unhealthy)
    root, target = str(Path(args.wiki_dir).resolve()), Path(args.vault_dir).resolve()
    there = [(str(p.relative_to(target)),) for p in target.rglob("*.md")] if target.exists() else []
    plan = vault.plan(vault.note_files(spark, root, [str(target)]), spark.createDataFrame(there, "relative_destination string"), config, root, yaml=True).cache()
    if args.command == "vault-plan":
        print(json.dumps([r.asDict() for r in plan.orderBy("relative_source").collect()], indent=2))
        return 1 if plan.where(F.col("rejected")).count() else 0
    if plan.where(F.col("rejected")).count() and not args.allow_partial:
        print("error: the plan rejects notes; see vault-plan", file=sys.stderr)
        return 1
    done = vault.apply(plan, str(target), root, config)
    print(json.dumps(done, indent=2))
    return 0 if done["success"] else 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="proofmill")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    sub.add_parser("diagnose")
    p = sub.add_parser("ingest")
    p.add_argument("path")
    p.add_argument("--manifest", default="./data/manifest.json")
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("health")
    p.add_argument("path")
    p.add_argument("--json", action="store_true")
    p.add_argument("--source-manifest")
    for name in ("vault-plan", "vault-adapt"):
        p = sub.add_parser(name)
        p.add_argument("wiki_dir")
        p.add_argument("vault_dir")
        p.add_argument("--overwrite", action="store_true")
        p.add_argument("--allow-unhealthy", action="store_true")
        p.add_argument("--allow-partial", action="store_true")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "diagnose":
        settings = Settings.from_env()
        print(json.dumps({"version": VERSION, "settings": {k: v for k, v in vars(settings).items() if k != "errors"}, "problems": settings.validate()}, indent=2))
        return 1 if settings.validate() else 0
    return {"ingest": _ingest, "health": _health}.get(args.command, _vault)(args)


if __name__ == "__main__":
    sys.exit(main())
