"""Command line: ``spark-submit`` or ``python -m tastegrid <job>``."""

import argparse

from .plans import jobs
from .session import build_session


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tastegrid")
    parser.add_argument("--root", help="folder for the tables of each run")
    job = parser.add_subparsers(dest="job", required=True)

    load = job.add_parser("load", help="ratings CSV to the ratings table")
    load.add_argument("csv")
    load.add_argument("--buckets", type=int, default=0)
    load.add_argument("--parts", type=int, default=0, help="lay ratings out by user")

    offline = job.add_parser("offline", help="fit the model, write the lists")
    offline.add_argument("--rank", type=int, default=30)
    offline.add_argument("--max-iter", type=int, default=10)
    offline.add_argument("--reg", type=float, default=0.01)
    offline.add_argument("--threshold", type=float, default=0.7)
    offline.add_argument("--neighbours", type=int)
    offline.add_argument("--exclude-seen", action="store_true")
    offline.add_argument("--buckets", type=int, default=0)
    offline.add_argument("--parts", type=int, default=0, help="lay neighbour lists out by item")
    offline.add_argument("--users", metavar="TABLE", help="give each user of this table a list")

    ingest = job.add_parser("ingest", help="append rating requests to the ratings table")
    ingest.add_argument("requests", help="Parquet files of (username, mid, score)")
    ingest.add_argument("users", help="table of (id, username)")
    ingest.add_argument("--rejects", help="folder for the requests of unknown names")

    tune = job.add_parser("tune", help="grid search over rank and regularisation")
    tune.add_argument("--max-iter", type=int, default=50)
    tune.add_argument("--parallelism", type=int, default=3)
    tune.add_argument("--rungs", action="store_true", help="drop bad points after few iterations")

    stream = job.add_parser("stream", help="answer rating messages of a Kafka topic")
    stream.add_argument("servers")
    stream.add_argument("out")
    stream.add_argument("--topic", default="recommend")
    stream.add_argument("--starting-offsets", default="latest")
    stream.add_argument("--max-offsets", type=int, help="messages of a micro-batch at most")
    stream.add_argument("--jdbc-url", help="write answers to a database, not to files")
    stream.add_argument("--jdbc-table", default=jobs.SERVED_RECS)
    stream.add_argument("--exclude-seen", action="store_true")
    stream.add_argument("--min-score", type=float)
    stream.add_argument("--keyed", action="store_true", help="keep what users have rated as state")

    args = parser.parse_args(argv)
    spark = build_session(f"tastegrid-{args.job}")
    if args.job == "load":
        jobs.load(spark, args.csv, args.root, args.buckets, parts=args.parts)
    elif args.job == "offline":
        jobs.offline(
            spark, args.root, threshold=args.threshold, neighbours=args.neighbours,
            exclude_seen=args.exclude_seen, buckets=args.buckets, parts=args.parts,
            users=spark.table(args.users) if args.users else None,
            rank=args.rank, max_iter=args.max_iter, reg=args.reg,
        )
    elif args.job == "ingest":
        jobs.ingest(
            spark, spark.read.parquet(args.requests), spark.table(args.users), args.rejects
        )
    elif args.job == "tune":
        search = {"rungs": True} if args.rungs else {"max_iter": args.max_iter}
        best = jobs.tune(spark, args.root, parallelism=args.parallelism, **search)
        print(best.first().asDict())
    else:
        jobs.kafka_stream(
            spark, args.servers, args.topic, args.out,
            starting_offsets=args.starting_offsets, max_offsets=args.max_offsets,
            jdbc_url=args.jdbc_url, jdbc_table=args.jdbc_table,
            exclude_seen=args.exclude_seen, min_score=args.min_score, keyed=args.keyed,
        ).awaitTermination()


if __name__ == "__main__":
    main()
