"""Chat formatting: a hidden Markov model recovers who speaks each line, then turns are rendered canonically.

States are the roles. A line shows a speaker marker (from the role column, or written at its beginning) and features of its
text. Roles persist inside a row; between rows, and at a written marker, they change by their own transition matrix. All
probabilities are smoothed counts over the rows whose role is known. Viterbi runs over whole conversations, however long:
the sorted rows of all conversations are cut into parts of about PART_ROWS rows, conversations that cross a cut are reduced
to a roles x roles matrix of best scores per part, the matrices of a conversation give, merged as a tree over ranges of
parts, the best roles at the cuts, and the parts are then decoded between them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.llm.tables import map_batches
from wardspan.session import write_stage

ROLES = ("system", "user", "assistant")
#: Fixed names of speakers, lower case.
NAMES = {"system": 0, "instruction": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "q": 1, "question": 1, "assistant": 2, "ai": 2, "bot": 2, "model": 2, "agent": 2, "a": 2, "answer": 2}
MARKER = re.compile(r"^\s*(?:[#>*\[<|]+\s*)?([A-Za-z]+)\s*(?:\|?>|\]|\*\*)?\s*:\s*")
#: Rows of a part, sampled rows per part that place the cuts, and parts of a conversation that are merged in one group.
PART_ROWS, SAMPLED, FAN = 1 << 13, 32, 1 << 10
ORDER = ("conv_id", "turn", "row", "tie")
#: Features of a line and their numbers of values.
FEATURES = {"words": 8, "question": 2, "ending": 3, "list": 2, "first": 2, "opening": 2}
MARKED = 0.98


def marker_of(name: str | None) -> int:
    return NAMES.get((name or "").strip().lower(), -1)


def line_features(line: str, first: bool, opening: bool) -> tuple[int, ...]:
    bare = line.strip()
    n = len(bare.split(None, 128))
    return (
        min(7, n.bit_length()),
        int("?" in bare),
        0 if bare.endswith((".", "!", "?")) else 1 if bare.endswith((":", ",", ";")) else 2,
        int(bare[:2] in ("- ", "* ", "1.")),
        int(first),
        int(opening),
    )


def read_lines(role: str | None, text: str | None, turn: int | None) -> list[tuple[str, int, bool, tuple[int, ...]]]:
    """The row's lines: text without written marker, role its marker names (-1: none), whether the speaker may change, features.

    A marker is believed inside a text only where no role column says otherwise.
    """
    given = marker_of(role)
    out = []
    for k, line in enumerate((text or "").split("\n")):
        marker, written = (given if not k else -1), False
        if given < 0:
            match = MARKER.match(line)
            if match and marker_of(match[1]) >= 0:
                marker, written, line = marker_of(match[1]), True, line[match.end() :]
        out.append((line, marker, not k or written, line_features(line, not k, turn == 0)))
    return out


@dataclass
class Model:
    """Log probabilities: start, change (between rows), stay (inside rows), marker (role x marker), line (per feature: role x value)."""

    start: np.ndarray
    change: np.ndarray
    stay: np.ndarray
    marker: np.ndarray
    line: list[np.ndarray]

    def emission(self, marker: int, shown: tuple[int, ...]) -> np.ndarray:
        score = self.marker[:, marker] if marker >= 0 else np.zeros(len(ROLES))
        return score + sum(table[:, v] for table, v in zip(self.line, shown, strict=True)) / len(shown)

    def step(self, changes: bool) -> np.ndarray:
        return self.change if changes else self.stay


def fit(rows: DataFrame) -> Model:
    """Smoothed counts over all rows with a known role; consecutive turns of a conversation give the transitions."""
    n = len(ROLES)

    def count(batch):
        seen: dict[tuple[int, int, int], int] = {}
        for role, text, turn in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), batch.column("turn").to_pylist(), strict=True):
            known = marker_of(role)
            if known >= 0:
                for _, _, _, shown in read_lines(role, text, turn):
                    for f, value in enumerate(shown):
                        seen[known, f, value] = seen.get((known, f, value), 0) + 1
        keys = list(seen)
        yield {"role": [k[0] for k in keys], "feature": [k[1] for k in keys], "value": [k[2] for k in keys], "n": [seen[k] for k in keys]}

    counted = map_batches(rows.select("role", "text", "turn"), count, "role int, feature int, value int, n long")
    tables = [np.ones((n, size)) for size in FEATURES.values()]
    for row in counted.groupBy("role", "feature", "value").agg(F.sum("n").alias("n")).collect():
        tables[row["feature"]][row["role"], row["value"]] += row["n"]
    number = F.coalesce(*[F.when(F.lower(F.trim("role")) == name, F.lit(k)) for name, k in NAMES.items()])
    known = rows.select("conv_id", "turn", number.alias("role")).where("role IS NOT NULL AND conv_id IS NOT NULL AND turn IS NOT NULL").distinct()
    after = known.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    change, start = np.full((n, n), 0.5), np.full(n, 0.5)
    for row in known.join(after, ["conv_id", "turn"]).groupBy("role", "next").count().collect():
        change[row["role"], row["next"]] += row["count"]
    for row in known.where("turn = 0").groupBy("role").count().collect():
        start[row["role"]] += row["count"]
    marker = np.full((n, n), (1 - MARKED) / (n - 1))
    np.fill_diagonal(marker, MARKED)
    stay = np.where(np.eye(n, dtype=bool), 0.0, -50.0)
    return Model(np.log(start / start.sum()), np.log(change / change.sum(1, keepdims=True)), stay, np.log(marker) * 8, [np.log(t / t.sum(1, keepdims=True)) for t in tables])


def chunk_matrix(model: Model, lines: list[tuple[int, bool, tuple[int, ...]]]) -> np.ndarray:
    """Best scores through the lines, by the role before them (last row: nothing before) and the role of the last line."""
    best = None
    for marker, changes, shown in lines:
        if best is None:
            best = np.vstack([model.step(changes), model.start])
        else:
            best = (best[:, :, None] + model.step(changes)[None]).max(axis=1)
        best = best + model.emission(marker, shown)
    return best


def decode(model: Model, lines: list[tuple[int, bool, tuple[int, ...]]], before: int | None, last: int | None) -> list[int]:
    """Viterbi over the lines after role `before` (None: at a start) that ends in role `last` (None: in the best)."""
    back, best = [], None
    for k, (marker, changes, shown) in enumerate(lines):
        if k:
            reach = best[:, None] + model.step(changes)
            back.append(reach.argmax(axis=0))
            best = reach.max(axis=0)
        else:
            best = model.start if before is None else model.step(changes)[before]
        best = best + model.emission(marker, shown)
    roles = [int(best.argmax()) if last is None else last]
    for pointers in reversed(back):
        roles.append(int(pointers[roles[-1]]))
    return roles[::-1]


def render(lines: list[str], roles: list[int]) -> tuple[str, list[str]]:
    """Canonical text of one row, a block per run of lines of one role, and the blocks' roles."""
    blocks: list[tuple[int, list[str]]] = []
    for line, role in zip(lines, roles, strict=True):
        if not blocks or blocks[-1][0] != role:
            blocks.append((role, []))
        blocks[-1][1].append(line)
    return "\n".join(f"<|{ROLES[role]}|>\n" + "\n".join(body).strip() + "\n<|end|>" for role, body in blocks), [ROLES[role] for role, _ in blocks]


def _plain_rows(table: pa.Table) -> list[dict]:
    return table.select(["turn", "role", "text", "row"]).to_pylist()


def _sorted_rows(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (r["turn"], r["row"]))


def _rows_of(table: pa.Table) -> list[dict]:
    return _sorted_rows(_plain_rows(table))


def in_parts(rows: DataFrame) -> DataFrame:
    """`rows` with a column part, numbered in the order of ORDER: about PART_ROWS rows each, whatever keys they have; and
    crosses, whether a cut lies in the row's conversation.

    The cuts come from a sample by the hash of the keys; `tie` tells equal rows apart, whose order does not matter.
    """
    n = rows.count()
    share = SAMPLED / PART_ROWS if n > PART_ROWS else 0.0
    picked = rows.select(*ORDER).where(F.pmod(F.xxhash64(F.lit(5), *ORDER), F.lit(1 << 30)) < int(share * (1 << 30)))
    kind = np.dtype([(c, np.int64) for c in ORDER])
    keys = np.sort(np.array([tuple(r) for r in picked.collect()], kind))
    cuts = rows.sparkSession.sparkContext.broadcast(keys[SAMPLED::SAMPLED])

    def place(batches):
        for batch in batches:
            each = np.empty(len(batch), kind)
            for c in ORDER:
                each[c] = batch.column(c).to_numpy()
            part = np.searchsorted(cuts.value, each, "right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(np.isin(each["conv_id"], cuts.value["conv_id"]))], names=[*batch.schema.names, "part", "crosses"])

    schema = rows.withColumn("part", F.lit(0).cast("long")).withColumn("crosses", F.lit(True)).schema
    return rows.mapInArrow(place, schema).drop("tie")


def _merged(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of consecutive parts as one."""
    out = matrices[0]
    for matrix in matrices[1:]:
        out = (out[:, :, None] + matrix[:-1][None]).max(axis=1)
    return out


def _cut_roles(matrices: list[np.ndarray], before: int | None, last: int | None) -> list[int]:
    """The best role at the end of each part, after role `before` and up to role `last` (None: free)."""
    best, back = matrices[0][-1 if before is None else before], []
    for matrix in matrices[1:]:
        reach = best[:, None] + matrix[:-1]
        back.append(reach.argmax(axis=0))
        best = reach.max(axis=0)
    roles = [int(best.argmax()) if last is None else last]
    for pointers in reversed(back):
        roles.append(int(pointers[roles[-1]]))
    return roles[::-1]


def cut_roles(matrices: DataFrame) -> DataFrame:
    """conv_id, part, before, last: the best roles before and at the end of each part of a conversation.

    At most FAN parts meet in a group; longer conversations are merged by ranges of parts first, and solved downwards.
    """

    def read(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        order = np.argsort(table["part"].to_numpy(), kind="stable")
        held = table["matrix"].to_pylist()
        return table["part"].to_numpy()[order], [np.array(held[k]).reshape(-1, len(ROLES)) for k in order]

    def solved(table: pa.Table, before: int | None, last: int | None) -> pa.Table:
        parts, held = read(table)
        roles = _cut_roles(held, before, last)
        conv = pa.array([table["conv_id"][0].as_py()] * len(parts), pa.int64())
        return pa.table({"conv_id": conv, "part": pa.array(parts, pa.int64()), "before": pa.array([before, *roles[:-1]], pa.int32()), "last": pa.array(roles, pa.int32())})

    def merge(table: pa.Table) -> pa.Table:
        matrix = _merged(read(table)[1]).reshape(-1).tolist()
        return pa.table({"conv_id": table["conv_id"][:1], "part": table["range"][:1], "matrix": pa.array([matrix], pa.list_(pa.float64()))})

    def down(table: pa.Table, above: pa.Table) -> pa.Table:
        return solved(table, above["before"][0].as_py(), above["last"][0].as_py())

    schema = "conv_id long, part long, before int, last int"
    most = matrices.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    if (most or 0) <= FAN:
        return matrices.groupBy("conv_id").applyInArrow(lambda table: solved(table, None, None), schema)
    ranged = matrices.withColumn("range", F.floor(F.col("part") / FAN))
    upper = write_stage(ranged.groupBy("conv_id", "range").applyInArrow(merge, "conv_id long, part long, matrix array<double>"), "part-matrices")
    above = write_stage(cut_roles(upper), "part-ends").withColumnRenamed("part", "range")
    return ranged.groupBy("conv_id", "range").cogroup(above.groupBy("conv_id", "range")).applyInArrow(down, schema)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, given_role, role, n_lines, n_blocks, rendered: one row per row of `conversations`.

    Needs conv_id, turn, role and text, ignores other columns. `role` is the recovered role of the row's first line. Unknown
    and null roles are recovered from written markers, the lines and the neighbouring turns; null and empty texts are one
    empty line. Several rows of one turn follow one another by the hash of role and text. Rows without conv_id or turn are
    decoded by themselves. An empty table gives an empty table.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    rows = rows.withColumn("row", F.xxhash64("role", F.lit(2), "text"))
    rows = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    rows = rows.withColumn("alone", alone)
    model = conversations.sparkSession.sparkContext.broadcast(fit(rows))

    def lines_of(row: dict) -> list:
        return read_lines(row["role"], row["text"], row["turn"])

    chained = in_parts(rows.where(~F.col("alone")).drop("alone"))

    def reduce_part(table: pa.Table) -> pa.Table:
        part, convs = table["part"][0].as_py(), table["conv_id"].to_numpy()
        edges = np.unique(convs).tolist()
        matrices = [chunk_matrix(model.value, [line[1:] for row in _rows_of(table.filter(pa.array(convs == conv))) for line in lines_of(row)]) for conv in edges]
        return pa.table({"conv_id": pa.array(edges, pa.int64()), "part": pa.array([part] * len(edges), pa.int64()), "matrix": pa.array([m.reshape(-1).tolist() for m in matrices], pa.list_(pa.float64()))})

    matrices = chained.where("crosses").groupBy("part").applyInArrow(reduce_part, "conv_id long, part long, matrix array<double>")
    ends = write_stage(cut_roles(write_stage(matrices, "part-matrices")), "part-ends")

    def write(rows: list[dict], before: int | None, last: int | None) -> dict[str, list]:
        read = [lines_of(row) for row in rows]
        roles = decode(model.value, [line[1:] for lines in read for line in lines], before, last)
        out: dict[str, list] = {c: [] for c in ("turn", "given_role", "role", "n_lines", "n_blocks", "rendered")}
        at = 0
        for row, lines in zip(rows, read, strict=True):
            text, blocks = render([line[0] for line in lines], roles[at : at + len(lines)])
            at += len(lines)
            for c, v in zip(out, (row["turn"], row["role"], blocks[0], len(lines), len(blocks), text), strict=True):
                out[c].append(v)
        return out

    schema = "conv_id long, turn long, given_role string, role string, n_lines long, n_blocks long, rendered string"
    types = {"turn": pa.int64(), "given_role": pa.string(), "role": pa.string(), "n_lines": pa.int64(), "n_blocks": pa.int64(), "rendered": pa.string()}

    def finish(table: pa.Table, border: pa.Table) -> pa.Table:
        known = {row["conv_id"]: (row["before"], row["last"]) for row in border.to_pylist()}
        held: dict[int, list[dict]] = {}
        for conv, row in zip(table["conv_id"].to_pylist(), _plain_rows(table), strict=True):
            held.setdefault(conv, []).append(row)
        out = {"conv_id": [], **{c: [] for c in types}}
        for conv, rows in held.items():
            done = write(_sorted_rows(rows), *known.get(conv, (None, None)))
            out["conv_id"] += [conv] * len(rows)
            for c in types:
                out[c] += done[c]
        return pa.table({"conv_id": pa.array(out["conv_id"], pa.int64()), **{c: pa.array(out[c], t) for c, t in types.items()}})

    decoded = chained.groupBy("part").cogroup(ends.groupBy("part")).applyInArrow(finish, schema)

    def single(batch):
        rows = [dict(zip(("turn", "role", "text"), r, strict=True)) for r in zip(*(batch.column(c).to_pylist() for c in ("turn", "role", "text")), strict=True)]
        out = [write([row], None, None) for row in rows]
        yield {"conv_id": batch.column("conv_id"), **{c: [o[c][0] for o in out] for c in types}}

    return decoded.unionAll(map_batches(rows.where("alone"), single, schema))
