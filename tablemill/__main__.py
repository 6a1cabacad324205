"""Command line: ``python -m tablemill JOB.yaml`` or ``--select GROUP:all``.

Exit code: 0 if all went well, 1 if a job or a rule that counts failed, 2 if the
call or a spec is wrong.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from tablemill.errors import SpecError
from tablemill.groups import JobGroups
from tablemill.runner import run_group, run_job
from tablemill.session import build_session
from tablemill.sources import load_connections
from tablemill.spec import JobSpec


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tablemill", description=__doc__)
    what = parser.add_mutually_exclusive_group(required=True)
    what.add_argument("job", nargs="?", help="path of a YAML job spec")
    what.add_argument("--select", help="a job, or GROUP:<name>")
    what.add_argument("--list", action="store_true", help="show what --select accepts")
    parser.add_argument("--jobs-dir", help="folder of job specs to use instead of the shipped ones")
    parser.add_argument("--groups", help="YAML file: group -> list of jobs")
    parser.add_argument("--params", default="{}", help="job parameters as a JSON object")
    parser.add_argument("--connections", help="YAML file: label -> connection")
    parser.add_argument("--base-path", help="root of all file connections")
    parser.add_argument("--base-uri", help="output location; without it results are shown")
    parser.add_argument("--report-uri", help="append the run report here")
    parser.add_argument("--environment", default="dev")
    parser.add_argument("--retries", type=int, default=3)
    parser.add_argument("--max-wait", type=float, default=60.0, help="longest wait, in seconds")
    parser.add_argument("--strict", action="store_true", help="renames must find their columns")
    parser.add_argument("--master", help="Spark master, if not set by spark-submit")
    parser.add_argument("--dry-run", action="store_true", help="plan, but write nothing")
    parser.add_argument("--log-level", default="INFO")
    return parser.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = parse(argv)
    logging.basicConfig(
        level=args.log_level.upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s"
    )
    try:
        # Everything that can be wrong without Spark is found before it starts.
        specs, groups = job_set(args)
        if args.list:
            for option, jobs in groups.listing().items():
                print(f"{option}\t{', '.join(jobs)}")
            return 0
        selection = args.select
        if args.job:
            spec = JobSpec.load(args.job)
            selection = spec.job_name
            specs, groups = {selection: spec}, JobGroups((selection,))
        groups.select(selection)
        connections = (
            load_connections(args.connections, args.base_path) if args.connections else {}
        )
    except (SpecError, FileNotFoundError) as error:
        print(error, file=sys.stderr)
        return 2
    options = {
        "connections": connections,
        "base_uri": args.base_uri,
        "retries": args.retries,
        "max_wait": args.max_wait,
        "strict": args.strict,
    }
    spark = build_session(master=args.master)
    try:
        if args.job and args.dry_run:
            done = run_job(
                spark, specs[selection], dry_run=True, params=args.params, **options
            )
            print(done.schema.simpleString())
            print(done.explain)
            return 0
        report = run_group(
            spark,
            selection,
            params=args.params,
            specs=specs,
            groups=groups,
            environment=args.environment,
            report_uri=args.report_uri,
            dry_run=args.dry_run,
            **options,
        )
        report.show(truncate=False)
        return 1 if report.filter("status LIKE 'failed%'").count() else 0
    except SpecError as error:
        print(error, file=sys.stderr)
        return 2
    finally:
        spark.stop()


def job_set(args: argparse.Namespace) -> tuple[dict[str, JobSpec], JobGroups]:
    """The jobs and groups that --select may name."""
    if not args.jobs_dir:
        groups = JobGroups.shipped()
        return {}, JobGroups.load(args.groups, groups.jobs) if args.groups else groups
    folder = Path(args.jobs_dir)
    if not folder.is_dir():
        raise FileNotFoundError(f"no folder {folder}")
    own = folder / "groups.yaml"
    specs = {
        path.stem: JobSpec.load(path)
        for path in sorted(folder.glob("*.yaml"))
        if path != own and not (args.groups and path.samefile(args.groups))
    }
    named = args.groups or (own if own.is_file() else None)
    return specs, JobGroups.load(named, specs) if named else JobGroups(tuple(specs))


if __name__ == "__main__":
    sys.exit(main())
