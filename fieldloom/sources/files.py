"""Constraint files: the binary R1CS format, symbol tables, and JSON systems."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from itertools import groupby, islice

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sum of products: constant, linear and product terms, coefficients as decimal text.
SYSTEM_JSON = "struct<constraints: array<struct<constant: string, linear: array<struct<coeff: string, witness: bigint>>, mul: array<struct<coeff: string, witness1: bigint, witness2: bigint>>>>, prime: string, field: string, number_of_signals: bigint, inputs: array<bigint>, outputs: array<bigint>>"
NODES_JSON = "struct<nodes: array<struct<node_id: bigint, constraints: array<bigint>, input_signals: array<bigint>, output_signals: array<bigint>, signals: array<bigint>, successors: array<bigint>>>, equivalency_local: array<array<bigint>>, equivalency_structural: array<array<bigint>>>"


class BadFile(ValueError):
    """A file that does not follow its format."""


HEADER = ("n_wires", "n_pub_out", "n_pub_in", "n_prv_in", "n_labels", "n_constraints")


def sections(data: bytes) -> dict[int, memoryview]:
    """The sections of a binary file by kind; they may come in any order."""
    if data[:4] != b"r1cs":
        raise BadFile("no r1cs magic")
    if len(data) < 12:
        raise BadFile("the file ends in its first line")
    version, n = struct.unpack_from("<ii", data, 4)
    if version != 1:
        raise BadFile(f"version {version}")
    at, found, whole = 12, {}, memoryview(data)
    for _ in range(n):
        if at + 12 > len(data):
            raise BadFile("a section is missing")
        kind, size = struct.unpack_from("<iq", data, at)
        if size < 0 or at + 12 + size > len(data):
            raise BadFile("a section ends after the file")
        found[kind] = whole[at + 12 : at + 12 + size]
        at += 12 + size
    if not {1, 2, 3} <= found.keys():
        raise BadFile("header, constraints or labels are missing")
    return found


def parse_header(head: bytes | memoryview) -> dict:
    """prime, width of a field element, and the counts of a header section."""
    try:
        (width,) = struct.unpack_from("<i", head, 0)
        counts = struct.unpack_from("<iiiiqi", head, 4 + width)
    except struct.error as error:
        raise BadFile("the header is too short") from error
    return {"prime": int.from_bytes(head[4 : 4 + width], "little"), "width": width} | dict(zip(HEADER, counts, strict=True))


def parse_terms(body: bytes | memoryview, header: dict) -> Iterator[tuple[int, str, int, int]]:
    """(coni, part, signal, coef) of a constraints section; of a signal that stands twice in a part the last one counts."""
    at, width = 0, header["width"]
    try:
        for coni in range(header["n_constraints"]):
            for part in "ABC":
                (count,) = struct.unpack_from("<i", body, at)
                at += 4
                found = {}
                for _ in range(count):
                    (signal,) = struct.unpack_from("<i", body, at)
                    found[signal] = int.from_bytes(body[at + 4 : at + 4 + width], "little")
                    at += 4 + width
                for signal, coef in found.items():
                    yield coni, part, signal, coef
    except struct.error as error:
        raise BadFile("the constraints end early") from error
    if at != len(body):
        raise BadFile("bytes are left after the constraints")


def parse_gates(found: dict[int, memoryview], width: int) -> tuple[list[tuple[str, list[int]]], list[tuple[int, list[int]]]]:
    """(gates used: name and parameters, gates applied: gate and signals) of the optional sections 4 and 5."""
    used, applied = [], []
    if 4 in found:
        data = bytes(found[4])
        (n,), at = struct.unpack_from("<i", data, 0), 4
        for _ in range(n):
            end = data.index(b"\0", at)
            name = data[at:end].decode()
            (k,), at = struct.unpack_from("<i", data, end + 1), end + 5
            used.append((name, [int.from_bytes(data[at + width * i : at + width * (i + 1)], "little") for i in range(k)]))
            at += width * k
    if 5 in found:
        data = bytes(found[5])
        (n,), at = struct.unpack_from("<i", data, 0), 4
        for _ in range(n):
            gate, k = struct.unpack_from("<ii", data, at)
            applied.append((gate, list(struct.unpack_from(f"<{k}q", data, at + 8))))
            at += 8 + 8 * k
    return used, applied


def parse_r1cs(data: bytes) -> tuple[dict, list[tuple[int, str, int, int]], list[int]]:
    """(header, terms (coni, part, signal, coef), labels) of a whole file."""
    found = sections(data)
    header = parse_header(found[1])
    return header, list(parse_terms(found[2], header)), [x for (x,) in struct.iter_unpack("<q", found[3])]


def encode_r1cs(header: dict, terms: list[tuple[int, str, int, int]], labels: list[int] | None = None) -> bytes:
    """The bytes of a file; terms in order of constraint, part and signal."""
    width, n = header.get("width", 32), header["n_constraints"]
    by: dict[tuple[int, str], list[tuple[int, int]]] = {}
    for coni, part, signal, coef in terms:
        by.setdefault((coni, part), []).append((signal, coef))
    head = struct.pack("<i", width) + header["prime"].to_bytes(width, "little") + struct.pack("<iiiiqi", header["n_wires"], header["n_pub_out"], header["n_pub_in"], header["n_prv_in"], header["n_wires"], n)
    body = bytearray()
    for coni in range(n):
        for part in "ABC":
            rows = sorted(by.get((coni, part), []))
            body += struct.pack("<i", len(rows))
            for signal, coef in rows:
                body += struct.pack("<i", signal) + coef.to_bytes(width, "little")
    wires = struct.pack(f"<{header['n_wires']}q", *(labels or range(header["n_wires"])))
    out = b"r1cs" + struct.pack("<ii", 1, 3)
    for kind, data in ((1, head), (2, bytes(body)), (3, wires)):
        out += struct.pack("<iq", kind, len(data)) + data
    return out


def _parsed(spark: SparkSession, path: str, rows, schema: str) -> DataFrame:
    """What ``rows(name, data)`` yields for each file at a path, in frames of bounded size; one file a task."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                found = rows(name, bytes(data))
                while part := list(islice(found, 100_000)):
                    yield pd.DataFrame(part, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


def read_r1cs(spark: SparkSession, path: str) -> DataFrame:
    """(circuit_id, prime, coni, part, signal, coef) of all files at a path; coefficients are decimal text."""

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        found = sections(data)
        header = parse_header(found[1])
        return ((name, str(header["prime"]), c, p, s, str(k)) for c, p, s, k in parse_terms(found[2], header))

    return _parsed(spark, path, rows, "circuit_id string, prime string, coni long, part string, signal long, coef string")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(circuit_id, prime and the counts of its header) of each file at a path."""

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        header = parse_header(sections(data)[1])
        return iter([(name, str(header["prime"]), *(header[k] for k in HEADER))])

    return _parsed(spark, path, rows, "circuit_id string, prime string, " + ", ".join(f"{k} long" for k in HEADER))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(circuit_id, wire, label): the label of each wire."""
    rows = lambda name, data: ((name, i, x) for i, (x,) in enumerate(struct.iter_unpack("<q", sections(data)[3])))
    return _parsed(spark, path, rows, "circuit_id string, wire long, label long")


def read_gates(spark: SparkSession, path: str) -> DataFrame:
    """(circuit_id, kind, place, gate, name, values): custom gates used, with their parameters, and applied, with their
    signals, both as comma-separated text; ``gate`` is the number of the gate used."""

    def rows(name: str, data: bytes) -> Iterator[tuple]:
        found = sections(data)
        used, applied = parse_gates(found, parse_header(found[1])["width"])
        text = lambda values: ",".join(map(str, values))
        yield from ((name, "used", i, i, gate, text(v)) for i, (gate, v) in enumerate(used))
        yield from ((name, "applied", i, gate, used[gate][0], text(v)) for i, (gate, v) in enumerate(applied))

    return _parsed(spark, path, rows, "circuit_id string, kind string, place long, gate long, name string, values string")


def _encoded_gates(used: list[tuple[str, list[int]]], applied: list[tuple[int, list[int]]], width: int) -> list[tuple[int, bytes]]:
    """Sections 4 and 5, if there is a gate."""
    if not used:
        return []
    four = struct.pack("<i", len(used)) + b"".join(n.encode() + b"\0" + struct.pack("<i", len(v)) + b"".join(x.to_bytes(width, "little") for x in v) for n, v in used)
    five = struct.pack("<i", len(applied)) + b"".join(struct.pack(f"<ii{len(v)}q", g, len(v), *v) for g, v in applied)
    return [(4, four), (5, five)]


def write_r1cs(terms: DataFrame, folder: str, prime: int, width: int = 32, roles: tuple[int, int, int] = (0, 0, 0), gates: tuple[list, list] = ((), ())) -> DataFrame:
    """Writes a binary file for each circuit of ``terms`` (circuit_id, coni, part, signal, coef) into ``folder``, and returns
    (circuit_id, path, n_constraints, n_terms).

    Constraints are 0 to the greatest coni, those without a term are empty. Rows of a circuit come to one task in order and are
    written as they come, so a task holds one factor at a time. A file appears whole: it is renamed once it is done, and a
    task that runs again writes it anew. roles: numbers of public outputs, public inputs and private inputs.
    """
    stats = terms.groupBy("circuit_id").agg((F.max("coni") + 1).alias("n_con"), F.count("*").alias("n_terms"), (F.max("signal") + 1).alias("n_wires"))
    # dealt by a hash of the name: by the name itself the exchange is dropped for the join's, whose rows stay where they are
    # if the join becomes a broadcast as it runs; then several tasks write one file
    rows = terms.join(stats, "circuit_id").repartition(F.xxhash64("circuit_id")).sortWithinPartitions("circuit_id", "coni", "part", "signal")
    rows = rows.select("circuit_id", "coni", "part", "signal", F.col("coef").cast("string").alias("coef"), "n_con", "n_terms", "n_wires")
    extra = _encoded_gates(list(gates[0]), list(gates[1]), width)

    def write(name: str, n_con: int, n_terms: int, n_wires: int, found: Iterator[tuple]) -> tuple:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        path, half = f"{base}/{name}.r1cs", f"{base}/.{name}-{uuid.uuid4().hex}"
        size = 12 * n_con + n_terms * (4 + width)
        with store.open_output_stream(half) as out:
            head = struct.pack("<i", width) + prime.to_bytes(width, "little") + struct.pack("<iiiiqi", n_wires, *roles, n_wires, n_con)
            out.write(b"r1cs" + struct.pack("<ii", 1, 3 + len(extra)) + struct.pack("<iq", 1, len(head)) + head + struct.pack("<iq", 2, size))
            at = 0
            for (coni, part), group in groupby(found, key=lambda r: (r[1], r[2])):
                place = 3 * coni + "ABC".index(part)
                out.write(bytes(4 * (place - at)))
                entries = [struct.pack("<i", s) + int(c).to_bytes(width, "little") for _, _, _, s, c in group]
                out.write(struct.pack("<i", len(entries)) + b"".join(entries))
                at = place + 1
            out.write(bytes(4 * (3 * n_con - at)))
            out.write(struct.pack("<iq", 3, 8 * n_wires))
            for first in range(0, n_wires, 1 << 16):
                last = min(n_wires, first + (1 << 16))
                out.write(struct.pack(f"<{last - first}q", *range(first, last)))
            for kind, data in extra:
                out.write(struct.pack("<iq", kind, len(data)) + data)
        store.move(half, path)
        return name, path, n_con, n_terms

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = (r for frame in frames for r in frame.itertuples(index=False, name=None))
        for (name, n_con, n_terms, n_wires), group in groupby(flat, key=lambda r: (r[0], *r[5:])):
            done = write(name, int(n_con), int(n_terms), int(n_wires), (r[:5] for r in group))
            yield pd.DataFrame([done], columns=["circuit_id", "path", "n_constraints", "n_terms"])

    return rows.mapInPandas(run, "circuit_id string, path string, n_constraints long, n_terms long")


def roles_of(header: dict) -> list[tuple[int, str]]:
    """Role of each wire by its place: the constant, outputs, inputs, the rest."""
    out, ins = header["n_pub_out"], header["n_pub_in"] + header["n_prv_in"]
    return [(s, "const" if s == 0 else "output" if s <= out else "input" if s <= out + ins else "internal") for s in range(header["n_wires"])]


def read_sym(spark: SparkSession, path: str) -> DataFrame:
    """(signal, name) of a symbol table: the second and fourth of four columns."""
    rows = spark.read.schema("label long, signal long, component long, name string").csv(path)
    return rows.select("signal", "name")


def terms_of_systems(systems: DataFrame, by: str = "circuit_id", json: str = "json") -> DataFrame:
    """(by, coni, kind, s1, s2, coef) from JSON texts: pairs in order, constants as linear terms of signal 0, zeros dropped;
    coefficients stay decimal text."""
    rows = systems.select(by, F.posexplode(F.from_json(json, SYSTEM_JSON)["constraints"]).alias("coni", "c"))
    lin = rows.select(by, "coni", F.explode("c.linear").alias("t")).select(by, "coni", F.lit("lin").alias("kind"), F.col("t.witness").alias("s1"), F.lit(None).cast("long").alias("s2"), F.col("t.coeff").alias("coef"))
    mul = rows.select(by, "coni", F.explode("c.mul").alias("t")).select(by, "coni", F.lit("mul").alias("kind"), F.least("t.witness1", "t.witness2").alias("s1"), F.greatest("t.witness1", "t.witness2").alias("s2"), F.col("t.coeff").alias("coef"))
    const = rows.select(by, "coni", F.lit("lin").alias("kind"), F.lit(0).cast("long").alias("s1"), F.lit(None).cast("long").alias("s2"), F.col("c.constant").alias("coef"))
    return lin.unionByName(mul).unionByName(const).where("coef is not null and coef not in ('0', '-0')")


def systems_of_terms(acir: DataFrame, by: str = "circuit_id", prime: str = "257") -> DataFrame:
    """(by, json): the JSON text of each system; an entry for each constraint in order."""
    lin = F.array_sort(F.collect_list(F.when(F.col("kind") == "lin", F.struct(F.col("s1").alias("witness"), F.col("coef").cast("string").alias("coeff")))))
    mul = F.array_sort(F.collect_list(F.when(F.col("kind") == "mul", F.struct(F.col("s1").alias("witness1"), F.col("s2").alias("witness2"), F.col("coef").cast("string").alias("coeff")))))
    cons = acir.groupBy(by, "coni").agg(lin.alias("linear"), mul.alias("mul")).withColumn("constant", F.lit("0"))
    whole = cons.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("coni", "constant", "linear", "mul"))).alias("c"))
    return whole.select(by, F.to_json(F.struct(F.lit(prime).alias("prime"), F.transform("c", lambda x: F.struct(x["constant"].alias("constant"), x["linear"].alias("linear"), x["mul"].alias("mul"))).alias("constraints"))).alias("json"))


def node_records(parts: DataFrame, inc: DataFrame, nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node_id, json) of each part: constraints, signals, inputs, outputs, successors, sorted."""
    own = parts.groupBy(F.col("part_id").alias("node_id")).agg(F.sort_array(F.collect_set("coni")).alias("constraints"))
    sig = inc.join(parts, "coni").groupBy(F.col("part_id").alias("node_id")).agg(F.sort_array(F.collect_set("signal")).alias("signals"))
    io = nodes.groupBy(F.col("node").alias("node_id")).agg(*(F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("signal")))).alias(n) for r, n in (("in", "input_signals"), ("out", "output_signals"))))
    succ = arcs.groupBy(F.col("src").alias("node_id")).agg(F.sort_array(F.collect_set("dst")).alias("successors"))
    rows = own.join(sig, "node_id", "left").join(io, "node_id", "left").join(succ, "node_id", "left")
    none = F.array().cast("array<long>")
    fields = ["constraints", "input_signals", "output_signals", "signals", "successors"]
    return rows.select("node_id", F.to_json(F.struct("node_id", *(F.coalesce(x, none).alias(x) for x in fields))).alias("json"))


def dot_rows(arcs: DataFrame) -> DataFrame:
    """Arcs as lines of a DOT graph."""
    return arcs.select(F.concat(F.col("src").cast("string"), F.lit(" -> "), F.col("dst").cast("string"), F.lit(";")).alias("line"))
