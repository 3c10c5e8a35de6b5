"""Decoders by name, and decoding to a fixpoint: what a decoder makes is offered to all decoders again.

A file is rows, one for each run of one side (RUN). A decoder is a function
from the rows of files that may be of its kind to the rows of the files that
it finds in them. In each round only the files that are new are offered; each
is taken by the first decoder, by name, that finds something in it. Rounds end
when nothing new is found, so their number is the depth of the deepest nesting
(a stream hidden by XOR that holds TLS that holds HTTP takes three).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tables import forget, lasting

FIRST = "struct<path:string,frame_no:long,ts_ns:long,src_ip:string,src_port:int,dst_ip:string,dst_port:int>"
#: A run of a file: the file's id, kind and parent, the stream at the root, the run's place, its bytes, and the file's properties.
RUN = f"file string, file_type string, parent string, depth int, stream string, name string, run int, side int, offset long, ts_ns long, content binary, missing_data boolean, first {FIRST}, is_metadata boolean, props map<string,string>"
#: What a decoder gives for each run; ``own`` are properties that it adds to, or changes of, the parent's.
MADE = f"parent string, file string, name string, run int, side int, offset long, ts_ns long, content binary, missing_data boolean, first {FIRST}, is_metadata boolean, own map<string,string>"


@dataclass(frozen=True)
class Options:
    """What decoders may know: rules by decoder, keys, and whether ports or contents tell a protocol."""

    rules: dict[str, list[dict[str, str]]] = field(default_factory=dict)
    xor_keys: DataFrame | None = None
    key_log: DataFrame | None = None
    private_keys: DataFrame | None = None
    any_port: bool = False


@dataclass(frozen=True)
class Decoder:
    """``fits`` tells for a run whether its file may be of this kind; with ``whole`` one run that fits stands for its file, else only runs that fit are given.

    ``decode(runs, options)`` gets RUN rows with ``stream`` as the id of the file and returns MADE rows.
    """

    name: str
    fits: Callable[[Options], Column]
    decode: Callable[[DataFrame, Options], DataFrame]
    whole: Callable[[Options], bool]


DECODERS: dict[str, Decoder] = {}


def decoder(name: str, fits: Callable[[Options], Column], whole: Callable[[Options], bool] = lambda o: False):
    """Registers a function as the decoder of a kind of files; a name that is taken stays with its first owner."""

    def add(f):
        DECODERS.setdefault(name, Decoder(name, fits, f, whole))
        return f

    return add


def properties(**cols: Column) -> Column:
    """A map of texts; what is null or empty is left out."""
    flat = [x for k, c in cols.items() for x in (F.lit(k), c.cast("string"))]
    return F.map_filter(F.create_map(*flat), lambda k, v: v.isNotNull() & (v != ""))


def made(parent: Column, suffix: Column, name: Column, content: Column, own: Column, *, run: Column | None = None, offset: Column | None = None, ts_ns: str = "ts_ns", is_metadata: Column | None = None, missing: Column | None = None) -> list[Column]:
    """The columns of MADE; ``suffix`` tells the file among those of its parent."""
    side = F.col("side") if run is not None else F.lit(0)
    cols = {
        "parent": parent, "file": F.concat(parent, F.lit("/"), suffix), "name": name, "run": F.lit(0) if run is None else run, "side": side, "offset": F.lit(0) if offset is None else offset, "ts_ns": F.col(ts_ns),
        "content": content, "missing_data": F.lit(False) if missing is None else missing, "first": F.col("first"), "is_metadata": F.lit(False) if is_metadata is None else is_metadata, "own": own,
    }
    kinds = {"run": "int", "side": "int", "offset": "long", "ts_ns": "long"}
    return [c.cast(kinds[k]).alias(k) if k in kinds else c.alias(k) for k, c in cols.items()]


def _offered(files: DataFrame, d: Decoder, options: Options) -> DataFrame:
    """The runs of ``files`` that a decoder gets: none of files of its own kind."""
    fits = (F.col("file_type") != d.name) & F.coalesce(d.fits(options), F.lit(False))
    if not d.whole(options):
        return files.where(fits)
    return files.join(files.where(fits).select("file").distinct(), "file", "left_semi")


def fixpoint(base: DataFrame, options: Options, decoders: dict[str, Decoder] | None = None, most_rounds: int = 16) -> tuple[DataFrame, DataFrame]:
    """(files, parsed): RUN rows of ``base`` and of all that decoders find in it, and the ids (file) of those that were decoded further.

    ``base`` should be lasting; each round's new files are written as a table,
    so plans stay small however deep files are nested. A nesting deeper than
    ``most_rounds`` is an error, never cut. An empty base ends at once.
    """
    known = DECODERS if decoders is None else decoders
    every, parsed, new = [base], [], base
    for depth in range(1, most_rounds + 2):
        order = sorted(known)
        fit = new.agg(*[F.count_if((F.col("file_type") != n) & F.coalesce(known[n].fits(options), F.lit(False))).alias(f"n{k}") for k, n in enumerate(order)]).first()
        found = []
        for k, n in enumerate(order):
            if fit[f"n{k}"]:
                runs = _offered(new, known[n], options).withColumn("stream", F.col("file"))
                found.append(known[n].decode(runs, options).withColumns({"__by": F.lit(k), "file_type": F.lit(n)}))
        if not found:
            break
        if depth > most_rounds:
            raise RuntimeError(f"files are nested deeper than {most_rounds}")
        heads = new.groupBy(F.col("file").alias("parent")).agg(F.first("stream").alias("stream"), F.first("props").alias("props"))
        made_ = reduce(DataFrame.unionByName, found)
        if len(found) > 1:
            made_ = lasting(made_)
            heads = heads.join(made_.groupBy("parent").agg(F.min("__by").alias("__first")), "parent")
        # What a parent tells meets the bytes that were made once, by the parent alone.
        chosen = made_.join(heads, "parent").where(F.col("__by") == F.col("__first") if len(found) > 1 else F.lit(True))
        props = F.map_concat(F.map_filter("props", lambda k, v: ~F.map_contains_key("own", k)), F.col("own"))
        rows = lasting(chosen.withColumns({"props": props, "depth": F.lit(depth)}).select(*[c.split()[0] for c in RUN.split(", ")]))
        if len(found) > 1:
            forget(made_)
        if rows.isEmpty():
            forget(rows)
            break
        every.append(rows)
        parsed.append(rows.select(F.col("parent").alias("file")).distinct())
        new = rows
    none = base.limit(0).select("file")
    return reduce(DataFrame.unionByName, every), reduce(DataFrame.unionByName, parsed, none)
