"""Command lines: python -m pocketloom.cli <command> ..."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from pocketloom.functions.ids import normal_ids, subset_file
from pocketloom.plans import affinity_model, linear
from pocketloom.plans.embedding import embedded, read_sequences
from pocketloom.plans.manifests import affinity_split_table, affinity_table, split_table
from pocketloom.plans.poses import ingest, pose_rows
from pocketloom.schemas import AFFINITY, FINGERPRINT_BITS, FRACTIONS, PROTEIN, RAW_BINDING, RESTARTS, SEED, SPLIT, TANIMOTO_THRESHOLD
from pocketloom.sources.matrices import write_matrix
from pocketloom.sources.sdf import read_docked
from pocketloom.sources.tables import guard_outputs, read_csv_checked, read_manifest, write_single_csv


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="pocketloom")
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("affinity-manifest")
    a.add_argument("--input-csv", required=True)
    a.add_argument("--affinity-out", required=True)
    s = sub.add_parser("split-manifest")
    s.add_argument("--affinity-csv", required=True)
    s.add_argument("--uniprot-ids", nargs="*")
    s.add_argument("--overwrite", action="store_true")
    s.add_argument("--global-protein-csv")
    s.add_argument("--tanimoto-threshold", type=float, default=TANIMOTO_THRESHOLD)
    s.add_argument("--fp-size", type=int, default=FINGERPRINT_BITS)
    s.add_argument("--seed", type=int, default=SEED)
    s.add_argument("--num-restarts", type=int, default=RESTARTS)
    for name, value in FRACTIONS.items():
        s.add_argument(f"--{name}-fraction", type=float, default=value)
    s.add_argument("--conflict-graph-cache")
    s.add_argument("--out-dir", required=True)
    j = sub.add_parser("affinity-split-manifest")
    for name in ("affinity-csv", "split-csv", "protein-csv", "output-csv"):
        j.add_argument(f"--{name}", required=True)
    j.add_argument("--uniprot-ids", nargs="*")
    j.add_argument("--overwrite", action="store_true")
    p = sub.add_parser("poses")
    for name in ("outputs-dir", "pose-manifest", "pose-graphs", "duplicates"):
        p.add_argument(f"--{name}", required=True)
    e = sub.add_parser("embed")
    e.add_argument("--input", required=True)
    e.add_argument("--output", required=True)
    e.add_argument("--dtype", default="float32")
    e.add_argument("--truncate-to", type=int, default=0)
    le = sub.add_parser("linear")
    le.add_argument("--experiment")
    for name in ("pose-csv", "affinity-split-csv", "output-dir"):
        le.add_argument(f"--{name}")
    t = sub.add_parser("train")
    t.add_argument("--experiment", required=True)
    t.add_argument("--dry-run", action="store_true")
    v = sub.add_parser("evaluate-test")
    v.add_argument("--experiment", required=True)
    v.add_argument("--checkpoint")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("pocketloom").getOrCreate()
    if args.command == "affinity-manifest":
        write_single_csv(affinity_table(read_csv_checked(spark, args.input_csv, RAW_BINDING.fieldNames())), args.affinity_out)
    elif args.command == "split-manifest":
        ids = normal_ids(args.uniprot_ids) if args.uniprot_ids else None
        out = {n: Path(args.out_dir) / subset_file(n, ids) for n in ("split_manifest.csv", "protein_manifest.csv", "split_manifest_report.txt")}
        guard_outputs(spark, out.values(), args.overwrite)
        known = read_manifest(spark, args.global_protein_csv, PROTEIN) if args.global_protein_csv else None
        shares = {s: getattr(args, f"{s}_fraction") for s in FRACTIONS}
        split, proteins, report = split_table(
            read_manifest(spark, args.affinity_csv, AFFINITY), ids, known, threshold=args.tanimoto_threshold, size=args.fp_size,
            fractions=shares, seed=args.seed, restarts=args.num_restarts, cache=args.conflict_graph_cache,
        )
        write_single_csv(split, out["split_manifest.csv"])
        write_single_csv(proteins, out["protein_manifest.csv"])
        out["split_manifest_report.txt"].write_text(report, encoding="utf-8")
    elif args.command == "affinity-split-manifest":
        guard_outputs(spark, [args.output_csv], args.overwrite)
        tables = [read_manifest(spark, p, s) for p, s in ((args.affinity_csv, AFFINITY), (args.split_csv, SPLIT), (args.protein_csv, PROTEIN))]
        write_single_csv(affinity_split_table(*tables, args.uniprot_ids or None), args.output_csv)
    elif args.command == "poses":
        ingest(pose_rows(read_docked(spark, args.outputs_dir)), args.pose_manifest, args.pose_graphs, args.duplicates)
    elif args.command == "embed":
        write_matrix(embedded(read_sequences(spark, args.input), longest=args.truncate_to), args.output, dtype=args.dtype)
    elif args.command == "linear":
        linear.evaluate(spark, args.experiment, args.pose_csv, args.affinity_split_csv, args.output_dir)
    elif args.command == "train":
        if args.dry_run:
            print(affinity_model.dry_run(spark, args.experiment))
        else:
            affinity_model.train(spark, args.experiment)
    elif args.command == "evaluate-test":
        affinity_model.evaluate_test(spark, args.experiment, args.checkpoint)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
