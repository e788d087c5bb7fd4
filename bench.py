"""Seconds per headline query on a stored quad table, and parse rates per format.

Prints one JSON line.  BENCH_SF_DIR names the tables, BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from quadloom import functions as fn  # noqa: E402
from quadloom import operators as op  # noqa: E402
from quadloom.fixtures import COMMENT, DOCS, EX, LABEL, PARTS, TRADE, table_quads  # noqa: E402
from quadloom.plans import model, quality  # noqa: E402
from quadloom.session import get_spark, scratch_path  # noqa: E402
from quadloom.sources import readers, store, writers  # noqa: E402
from quadloom.sources.turtle import parse_turtle  # noqa: E402
from quadloom.terms import RDF_TYPE, Iri, Var  # noqa: E402
from workload.sources import customer_turtle, files_of  # noqa: E402
from workload.tables import SHAPES, SPEC  # noqa: E402

V, A = Var, Iri(RDF_TYPE)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def queries(g, trade, parts, docs):
    """Name to a function that builds the frame, on the stored graph."""
    def ex(name):
        return Iri(EX + name)

    def star(**how):
        return op.star(trade, {"name": EX + "name", "balance": EX + "balance", "segment": EX + "segment",
                               "mbox": EX + "mbox"}, EX + "Customer", "c", **how)

    def chain():
        return op.bgp(g, [
            (V("o"), ex("customer"), V("c")), (V("o"), ex("total"), V("t")), (V("c"), ex("name"), V("name")),
            (V("c"), ex("nation"), V("n")), (V("n"), Iri(LABEL), V("nation")), (V("n"), ex("region"), V("r")),
            (V("r"), Iri(LABEL), V("region"))])

    def members():
        b = op.bgp(g, [(V("n"), A, ex("Nation")), (V("n"), Iri(LABEL), V("label")), (V("n"), ex("hasCustomer"), V("m"))])
        return op.top_k(op.group(b, ["label"], n=op.count_distinct("m")), [op.desc("n"), "label"], 20)

    def totals():
        b = op.bgp(trade, [(V("o"), ex("customer"), V("c")), (V("o"), ex("total"), V("t"))])
        return op.group(b, ["c"], total=op.sum_term("t"), mean=op.avg_term("t"))

    return {
        "star_one_pass": lambda: star(functional=("name", "balance", "segment", "mbox")),
        "star_joins": star,
        "chain_six_patterns": chain,
        "mutual_pairs": lambda: op.mutual_pairs(trade, EX + "knows"),
        "count_distinct_members": members,
        "count_distinct_parts": lambda: op.group(
            op.pattern(trade, V("s"), ex("supplies"), V("p")), ["s"], n=op.count_distinct("p")),
        "sum_per_customer": totals,
        "keyword_filter": lambda: op.keyword_filter(op.pattern(docs, V("d"), Iri(COMMENT), V("text")), "text", "the "),
        "optional_labels": lambda: op.optional(op.instances(docs, EX + "Document", "d"),
                                               op.pattern(docs, V("d"), ex("quality"), V("q"))),
        "minus_labels": lambda: op.minus(op.instances(docs, EX + "Document", "d"),
                                         op.pattern(docs, V("d"), ex("quality"), V("q"))),
        "filter_dates": lambda: op.where(op.pattern(trade, V("o"), ex("date"), V("d")), fn.year(F.col("d")) == 1996),
        "closure_broader": lambda: op.path_closure(parts, EX + "broader"),
        "paging_orders": lambda: op.paginate(op.pattern(trade, V("o"), ex("total"), V("t")), ["t", "o"], unique_rows=True),
        "top_orders": lambda: op.top_k(op.pattern(trade, V("o"), ex("total"), V("t")), [op.desc("t"), "o"], 50),
        "attribute_facts": lambda: model.attribute_facts(g, SPEC),
        "entity_table": lambda: model.entity_table(
            g, SPEC, ["Customer", "customer_name", "segment", "Nation", "nation_label"], functional=("customer_name", "segment")),
        "nested_documents": lambda: model.documents(g, SPEC, "Nation", depth=1),
        "predicate_counts": lambda: quality.predicate_counts(g),
        "inverse_violations": lambda: quality.inverse_violations(trade, EX + "nation", EX + "hasCustomer"),
        "shape_violations": lambda: quality.validate_shapes(g, SHAPES),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_spark("quadloom-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    rates: dict[str, int] = {}

    def timed(name, action):
        start = time.perf_counter()
        out = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    place = scratch_path(spark, "store")
    store.reload_quads(table_quads(spark, sf), place)  # compile once
    timed("store_load", lambda: store.reload_quads(table_quads(spark, sf), place))
    quads = store.read_store(spark, place)
    n = quads.count()
    rates["store_load"] = int(n / seconds["store_load"])

    lines = quads.filter(F.col("g").isin(TRADE, DOCS))
    for fmt, graphs in (("nt", False), ("nq", True)):
        folder = scratch_path(spark, fmt)
        writers.write_nquads(lines, folder, graphs)
        files, _ = files_of(spark, folder, fmt)
        parsed = readers.read_quads(spark, files)
        count = parsed.count()
        timed(f"parse_{fmt}", lambda p=parsed: run(p))
        rates[f"parse_{fmt}"] = int(count / seconds[f"parse_{fmt}"])
    folder = scratch_path(spark, "ttl")
    customer_turtle(spark, sf).repartition(int(cpus)).write.text(folder)
    files, _ = files_of(spark, folder, "ttl")
    parsed = parse_turtle(spark, files)
    count = parsed.count()
    timed("parse_ttl", lambda: run(parsed))
    rates["parse_ttl"] = int(count / seconds["parse_ttl"])

    # one graph each, or graphs without a common triple: no merge is needed
    graph = quads.select("s", "s_kind", "p", "o")
    trade, parts, docs = (op.from_graphs(quads, [x]) for x in (TRADE, PARTS, DOCS))
    for name, build in queries(graph, trade, parts, docs).items():
        run(build())  # compile once
        timed(name, lambda b=build: run(b()))
    print(json.dumps({
        "metric": "headline queries and parsing", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "quads": n, "quads_per_sec": rates, "cpus": int(cpus),
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
