"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Turns of a conversation are streamed in order through the machine, which checks the order of roles and emits text segments,
each with a flag saying whether it is under the loss.  Texts are escaped so that no control string of the template can occur in
them, and ``read_back`` recovers every turn exactly.

Null texts are empty; a null role is the empty role; roles the template does not know get its ``other`` marker and make the
conversation invalid, but are still formatted.  Rows of one turn number are taken in order of role and text; repeated rows repeat.
A conversation of any length is streamed turn by turn, never held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    """``opens`` maps roles to their opening marker; ``moves`` maps a state (last role, or ``""``) to roles allowed next."""

    opens: dict = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    other: str = "### Other: "
    other_end: str = " ::: "
    close: str = "</turn>\n"
    escape: str = "\\"
    loss_roles: frozenset = frozenset({"assistant"})
    moves: dict = field(default_factory=lambda: {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    ends: frozenset = frozenset({"user", "assistant"})

    def controls(self) -> list[str]:
        """Strings that may not occur unescaped in a text: each marker without trailing white space, and the escape itself."""
        return [self.escape, *sorted({x.strip() for x in (*self.opens.values(), self.other, self.other_end, self.close)}, key=lambda x: (-len(x), x))]

    def check(self) -> None:
        marks = self.controls()[1:]
        if len(self.escape) != 1 or any(self.escape in x or not x for x in marks):
            raise ValueError("markers must be non-empty and free of the one-character escape")


class Formatter:
    """``text`` marks: every control string inside a text gets the escape in front of it."""

    def __init__(self, template: Template):
        template.check()
        self.t = template
        self._controls = re.compile("|".join(map(re.escape, template.controls())))
        self._escaped = re.compile(re.escape(template.escape) + r"(.)", re.S)
        marks = [*sorted(set(template.opens.values()), key=len, reverse=True), template.other]
        self._roles = {v: k for k, v in template.opens.items()}
        self._open = re.compile("|".join(map(re.escape, marks)))
        self._stop = re.compile(re.escape(template.escape) + r"." + "|(" + re.escape(template.close) + ")", re.S)
        self._role_stop = re.compile(re.escape(template.escape) + r"." + "|(" + re.escape(template.other_end) + ")", re.S)

    def escape(self, text: str) -> str:
        return self._controls.sub(lambda m: self.t.escape + m[0], text)

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """One turn as (text, under the loss) segments."""
        known = role in self.t.opens
        head = self.t.opens[role] if known else self.t.other + self.escape(role) + self.t.other_end
        return [(head, False), (self.escape(text), role in self.t.loss_roles), (self.t.close, False)]

    def step(self, state: str, role: str) -> bool:
        return role in self.t.moves.get(state, ())

    def _until(self, stop: re.Pattern, text: str, at: int) -> tuple[int, int]:
        while True:
            m = stop.search(text, at)
            if not m:
                raise ValueError("a turn is not closed")
            if m[1] is not None:
                return m.start(), m.end()
            at = m.end()

    def read_back(self, formatted: str) -> list[tuple[str, str]]:
        """Turns (role, text) of a formatted string."""
        turns, at = [], 0
        while at < len(formatted):
            m = self._open.match(formatted, at)
            if not m:
                raise ValueError(f"no turn begins at {at}")
            at = m.end()
            if m[0] in self._roles:
                role = self._roles[m[0]]
            else:
                stop, at_text = self._until(self._role_stop, formatted, at)
                role, at = self.unescape(formatted[at:stop]), at_text
            stop, after = self._until(self._stop, formatted, at)
            turns.append((role, self.unescape(formatted[at:stop])))
            at = after
        return turns


def format_chat(df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, nth, segments array<struct<text, loss>>, valid_step)``: a row for each turn, in order within its partition."""
    template = template or Template()
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        import pyarrow as pa

        form, last, state, nth = Formatter(template), object(), "", 0
        target = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo, 256), ([], [], [], [])
                for conv, _, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if conv != last:
                        last, state, nth = conv, "", 0
                    for column, value in zip(out, (conv, nth, [{"text": t, "loss": x} for t, x in form.segments(role, text)], form.step(state, role)), strict=True):
                        column.append(value)
                    state, nth = role, nth + 1
                yield pa.RecordBatch.from_arrays([pa.array(out[0], part.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], target), pa.array(out[3])], names=["conv_id", "nth", "segments", "valid_step"])

    return rows.mapInArrow(run, f"conv_id {kind}, nth long, segments array<struct<text:string,loss:boolean>>, valid_step boolean")


def chat_digests(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads the segments of ``format_chat`` back, conversation by conversation, and digests turns and loss text.

    Must run on ``format_chat``'s own output, whose partitions hold whole conversations in order; rows out of order are an error.
    """
    template = template or Template()
    kind = dict(formatted.dtypes)["conv_id"]

    def run(batches):
        import pyarrow as pa

        form, names = Formatter(template), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        now = None

        def done(s):
            return s["conv"], s["turns"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["valid"] and s["role"] in template.ends

        def batch_of(rows, kind):
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        id_type = pa.int64()
        for batch in batches:
            out, id_type = [], batch.column(0).type
            for lo in range(0, batch.num_rows, 256):
                for conv, nth, segments, step in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    if nth == 0:
                        if now:
                            out.append(done(now))
                        now = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "valid": True, "role": "", "rows": 0}
                    if not now or now["conv"] != conv or now["rows"] != nth:
                        raise ValueError(f"turn {nth} of conversation {conv} is out of order")
                    now["rows"] += 1
                    whole = "".join(s["text"] for s in segments)
                    now["chars"] += len(whole)
                    now["valid"] &= step
                    for role, text in form.read_back(whole):
                        now["turns"] += 1
                        now["role"] = role
                        now["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    for s in segments:
                        if s["loss"]:
                            said = form.unescape(s["text"])
                            now["loss_chars"] += len(said)
                            now["loss"].update(said.encode("utf-8", "surrogatepass"))
            if out:
                yield batch_of(out, id_type)
        if now:
            yield batch_of([done(now)], id_type)

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the escaping probe -7, formatted, read back and digested."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast(dict(talks.dtypes)["conv_id"]).alias("conv_id"), F.col("id").cast(dict(talks.dtypes)["turn"]).alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text"),
    )
    return chat_digests(format_chat(talks.unionByName(probe)))
