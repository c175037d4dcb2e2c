"""Roles of a transcript's lines by a hidden Markov model, and canonical turns.

States are roles, each as the first line of a turn or a later one. A line's observation is the
speaker marker it begins with, if any, whether it begins a row of the table, its length and
whether it asks. Chances are counted on transcripts whose roles are known; Viterbi's algorithm
then finds the most likely states, so turns without a marker get a role too, and words that only
look like a marker needn't start a turn.

A conversation of any length is cut into chunks of bounded size. A chunk's effect is a small
matrix, the best path from each state before it to each state at its end. These matrices give
the states at the chunks' borders, and each chunk is decoded between its borders: the result is
that of one run over the whole conversation. What one task gets of a long conversation is a
matrix per CHUNK_LINES lines.
"""

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from leadmill.llm.folds import held_out
from leadmill.llm.staging import stage

ROLES = ("system", "user", "assistant")
CHUNK_LINES = 4096
CHUNK_CHARS = 1 << 20

#: Names that speakers go by.
NAMES = {
    "system": ("system", "sys", "context"),
    "user": ("user", "human", "customer", "prompt", "instruction", "question", "q"),
    "assistant": ("assistant", "ai", "bot", "gpt", "agent", "response", "answer", "a"),
}
_ROLE_OF = {n: k for k, role in enumerate(ROLES) for n in NAMES[role]}
_MARKER = re.compile(
    r"\s*(?:(?:<\|(?:im_start\|>)?|#{1,3} ?|\[|\*\*)(%s)(?:\|>|\]|:?\*\*:?|:|\s*$)|(%s)\s?:)\s*"
    % ("|".join(_ROLE_OF), "|".join(_ROLE_OF)),
    re.IGNORECASE,
)
_END = re.compile(r"(?:<\|im_end\|>|<\|end\|>|</s>)\s*$")

STATES = 2 * len(ROLES)  # 2 * role for a first line, 2 * role + 1 for a later one
SYMBOLS = 4 * 2 * 3 * 2


def observe(line: str, first: bool) -> int:
    m = _MARKER.match(line)
    marker = 0 if not m else 1 + _ROLE_OF[(m[1] or m[2]).lower()]
    words = line.count(" ")
    length = 0 if words < 8 else 1 if words < 40 else 2
    return ((marker * 2 + first) * 3 + length) * 2 + _END.sub("", line).rstrip().endswith("?")


def spoken(line: str) -> str:
    """A line without its marker and end mark."""
    m = _MARKER.match(line)
    return _END.sub("", line[m.end() :] if m else line)


@dataclass
class Model:
    """Logarithms of chances: start of a state, next[state before, state], seen[state, symbol]."""

    start: np.ndarray
    next: np.ndarray
    seen: np.ndarray

    def matrix(self, symbols: np.ndarray) -> np.ndarray:
        """Best log chance from each state before the lines (or the start, last) to each at the end."""
        score = np.vstack([self.next, self.start]) + self.seen[:, symbols[0]]
        for s in symbols[1:]:
            score = (score[:, :, None] + self.next[None]).max(1) + self.seen[:, s]
        return score

    def decode(self, symbols: np.ndarray, before: int | None, end: int | None) -> np.ndarray:
        """Most likely states, given the state before and that at the end, if known."""
        score = (self.start if before is None else self.next[before]) + self.seen[:, symbols[0]]
        back = np.zeros((len(symbols), STATES), np.int8)
        for t, s in enumerate(symbols[1:], 1):
            paths = score[:, None] + self.next
            back[t] = paths.argmax(0)
            score = paths.max(0) + self.seen[:, s]
        out = np.zeros(len(symbols), np.int8)
        out[-1] = score.argmax() if end is None else end
        for t in range(len(symbols) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out


def chunks(rows: DataFrame) -> DataFrame:
    """conv, part, no (their order), and lines, firsts (of a row) and roles of bounded chunks.

    rows: conv_id, turn, text and role (null where unknown). A conversation's rows go by turn,
    nulls first, then by a hash of the text; repeated rows count once.
    """
    tie = F.xxhash64("text", "role")
    rows = rows.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("role").cast("string"),
    ).distinct()
    rows = rows.withColumn("tie", tie)
    ordered = rows.repartitionByRange("conv_id", "turn", "tie").sortWithinPartitions("conv_id", "turn", "tie")

    def work(batches):
        now, out, no = None, [], 0
        columns = ["conv_id", "no", "lines", "firsts", "roles"]

        def frame():
            f = pd.DataFrame([x[:5] for x in out], columns=columns)
            return f.astype({"conv_id": "Int64"})

        for pdf in batches:
            convs = [None if pd.isna(c) else int(c) for c in pdf["conv_id"]]
            for conv, text, role in zip(convs, pdf["text"], pdf["role"]):
                for k, line in enumerate(text.split("\n")):
                    if now is None or now[0] != conv or len(now[2]) >= CHUNK_LINES or now[5] >= CHUNK_CHARS:
                        if len(out) >= 200:
                            yield frame()
                            out = []
                        now = [conv, no, [], [], [], 0]
                        no += 1
                        out.append(now)
                    now[2].append(line)
                    now[3].append(k == 0)
                    now[4].append(role)
                    now[5] += len(line)
        if out:
            yield frame()

    cut = ordered.select("conv_id", "text", "role").mapInPandas(
        work, "conv_id long, no int, lines array<string>, firsts array<boolean>, roles array<string>"
    )
    return cut.withColumn("part", F.spark_partition_id())


def _symbols(lines, firsts) -> np.ndarray:
    return np.array([observe(x, bool(f)) for x, f in zip(lines, firsts)], np.int64)


def train(parts: DataFrame) -> Model:
    """Count on the chunks of conversations outside the held-out fold, on rows with a known role.

    Lines are counted as the table's rows have them and as one text without rows, as transcripts
    are pasted. Each count starts at a half. Without known roles all states are equally likely, but a role
    changes at the first line of a turn only.
    """

    def work(batches):
        for pdf in batches:
            first = np.zeros(STATES, np.int64)
            step = np.zeros((STATES, STATES), np.int64)
            seen = np.zeros((STATES, SYMBOLS), np.int64)
            for lines, firsts, roles, no in zip(pdf["lines"], pdf["firsts"], pdf["roles"], pdf["begins"]):
                last = None
                # As one text, in which only its first line begins a row.
                joined = _symbols(lines, [firsts[0]] + [False] * (len(lines) - 1))
                for s, j, f, role in zip(_symbols(lines, firsts), joined, firsts, roles):
                    if role not in ROLES:
                        last = None
                        continue
                    state = 2 * ROLES.index(role) + (not f)
                    seen[state, s] += 1
                    seen[state, j] += 1
                    if last is not None:
                        step[last, state] += 1
                    elif no:
                        first[state] += 1
                    last = state
            flat = np.concatenate([first, step.ravel(), seen.ravel()])
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"at": at, "n": flat[at]})

    known = parts.where(~held_out("conv_id")).select(
        "lines", "firsts", "roles", F.lit(True).alias("begins")
    )
    counts = np.full(STATES + STATES * STATES + STATES * SYMBOLS, 0.5)
    for r in known.mapInPandas(work, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"]] += r["n"]
    start, step, seen = np.split(counts, [STATES, STATES + STATES**2])
    start, step, seen = start.copy(), step.reshape(STATES, -1), seen.reshape(STATES, -1)
    start[1::2] = 0  # a conversation begins with a turn
    for a in range(STATES):
        for b in range(1, STATES, 2):
            if a // 2 != b // 2:
                step[a, b] = 0
    with np.errstate(divide="ignore"):
        return Model(*[np.log(x / x.sum(-1, keepdims=True)) for x in (start, step, seen)])


def _borders(parts: DataFrame, model: Model) -> DataFrame:
    """For chunks of conversations with several: the states before and at the end, and chunk (from 0)."""
    several = (
        parts.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("long"))
    )

    def matrices(batches):
        for pdf in batches:
            m = [model.matrix(_symbols(x, f)).tobytes() for x, f in zip(pdf["lines"], pdf["firsts"])]
            yield pdf[["conv_id", "part", "no"]].astype({"conv_id": "Int64"}).assign(m=m)

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "no"], ignore_index=True)
        all_ = [np.frombuffer(m).reshape(STATES + 1, STATES) for m in pdf["m"]]
        score, back = all_[0][STATES], []
        for m in all_[1:]:
            paths = score[:, None] + m[:STATES]
            back.append(paths.argmax(0))
            score = paths.max(0)
        ends = [int(score.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends.reverse()
        out = pdf[["conv_id", "part", "no"]].astype({"conv_id": "Int64"})
        return out.assign(before=[-1, *ends[:-1]], end=ends, chunk=range(len(out)))

    found = parts.join(several, F.col("conv_id").eqNullSafe(F.col("long"))).select(
        "conv_id", "part", "no", "lines", "firsts"
    )
    return (
        found.mapInPandas(matrices, "conv_id long, part int, no int, m binary")
        .groupBy("conv_id")
        .applyInPandas(path, "conv_id long, part int, no int, before int, end int, chunk int")
    )


def parse(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """Turns of transcripts: conv_id, turn_no (from 0), chunk, role, n_lines, text and rendered.

    rows: conv_id, turn, text, and role where it is known, for training; roles of rows are never
    used for decoding. Null texts are empty lines; rows without conv_id are one conversation. A
    turn that goes on in a next chunk has a row for each. rendered is the canonical form, with
    its head in the turn's first row and its end mark in each.
    """
    if "role" not in rows.columns:
        rows = rows.withColumn("role", F.lit(None).cast("string"))
    parts = stage(chunks(rows), "chunks").df
    model = model or train(parts)
    borders = stage(_borders(parts, model), "borders").df
    at = borders.select("part", "no", "before", "end", "chunk")

    def decode(batches):
        columns = ["conv_id", "part", "no", "chunk", "local", "role", "n_lines", "text", "begins"]
        for pdf in batches:
            out = []
            for conv, part, no, lines, firsts, before, end, chunk in zip(
                pdf["conv_id"], pdf["part"], pdf["no"], pdf["lines"], pdf["firsts"],
                pdf["before"], pdf["end"], pdf["chunk"],
            ):
                states = model.decode(
                    _symbols(lines, firsts),
                    None if pd.isna(before) or before < 0 else int(before),
                    None if pd.isna(end) else int(end),
                )
                cuts = [0] + [t for t in range(1, len(states)) if states[t] % 2 == 0] + [len(states)]
                local = -1
                for a, b in zip(cuts, cuts[1:]):
                    local += states[a] % 2 == 0
                    text = "\n".join(spoken(x) for x in lines[a:b]).strip("\n")
                    out.append(
                        (None if pd.isna(conv) else int(conv), part, no,
                         0 if pd.isna(chunk) else int(chunk), local, ROLES[states[a] // 2], b - a,
                         text, states[a] % 2 == 0)
                    )
            yield pd.DataFrame(out, columns=columns).astype({"conv_id": "Int64", "begins": bool})

    turns = stage(
        parts.join(at, ["part", "no"], "left")
        .select("conv_id", "part", "no", "lines", "firsts", "before", "end", "chunk")
        .mapInPandas(
            decode,
            "conv_id long, part int, no int, chunk int, local int, role string, n_lines int, "
            "text string, begins boolean",
        ),
        "turns",
    ).df
    # Turns of earlier chunks of the same conversation.
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        turns.join(borders.select("part", "no").distinct(), ["part", "no"])
        .groupBy("conv_id", "part", "no", "chunk")
        .agg(F.sum(F.col("begins").cast("int")).alias("n"))
        .withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select("part", "no", "earlier")
    )
    head = F.when(F.col("begins"), F.concat(F.lit("<|"), "role", F.lit("|>\n"))).otherwise(F.lit(""))
    return turns.join(before, ["part", "no"], "left").select(
        "conv_id",
        (F.coalesce("earlier", F.lit(0)) + F.col("local")).cast("long").alias("turn_no"),
        "chunk", "role", "n_lines", "text",
        F.concat(head, "text", F.lit("\n<|end|>\n")).alias("rendered"),
    )


def transcribe(conversations: DataFrame) -> DataFrame:
    """Transcripts as people paste them: each conversation in one of four styles of markers, and
    every fifth turn, by a hash, without a marker. Columns as conversations; role is kept."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0
    text, role = F.coalesce("text", F.lit("")), F.col("role")
    name = F.initcap(role)
    human = F.when(role == "user", "Human").otherwise(name)
    letter = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise(name)
    marked = (
        F.when(bare | ~F.coalesce(role.isin(*ROLES), F.lit(False)), text)
        .when(style == 0, F.concat(name, F.lit(": "), text))
        .when(style == 1, F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>")))
        .when(style == 2, F.concat(F.lit("### "), human, F.lit(":\n"), text))
        .otherwise(F.concat(letter, F.lit(": "), text))
    )
    return conversations.select("conv_id", "turn", marked.alias("text"), "role")
