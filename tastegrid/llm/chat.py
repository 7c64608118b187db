"""Chat formatting: a state machine over roles, and a declarative template.

Each row of a conversation becomes segments of text with a flag that says whether they
count for the loss. The template's control strings are escaped inside texts, so that
the formatted text can be read back turn by turn. A conversation's rows pass through a
task one by one in their order; none is held whole.
"""

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Characters of a read text that are handed on at once.
PIECE = 1 << 20


@dataclass(frozen=True)
class Template:
    """How turns are marked, and which roles may follow each other.

    A turn is ``head`` with the role's name, the text, and ``tail``. ``follows`` gives
    for each role the roles that may come next, "" being the start; ``loss`` names the
    roles whose texts count. A line of a text that starts like a head, or holds the
    tail, gets ``escape`` before it, and so does every escape of the text itself.
    """

    head: str = "### {role}: "
    tail: str = " </turn>\n"
    escape: str = "\\"
    names: dict = field(default_factory=lambda: {
        "system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    follows: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",),
        "assistant": ("user", "tool"), "tool": ("assistant", "tool")})
    loss: tuple = ("assistant",)

    def controls(self) -> list[str]:
        """What a text may not hold as it is: the escape, and the visible parts of the
        head and the tail."""
        return [self.escape, self.head.split("{role}")[0].strip(), self.tail.strip()]

    def protected(self, text: str) -> str:
        """``text`` with an escape before each control string."""
        return self._control().sub(lambda m: self.escape + m[0], text)

    def plain(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}({self._control().pattern})", r"\1", text)

    def _control(self) -> re.Pattern:
        longest_first = sorted(self.controls(), key=len, reverse=True)
        return re.compile("|".join(map(re.escape, longest_first)))

    def opening(self, role: str) -> str:
        """The head of a turn. A role without a name of its own is written with its
        control strings and colons escaped."""
        name = self.names.get(role)
        if name is None:
            name = "=" + self.protected(role).replace(":", self.escape + ":")
        return self.head.format(role=name)

    def role_of(self, name: str) -> str:
        if name.startswith("="):
            return self.plain(name[1:].replace(self.escape + ":", ":"))
        for role, own in self.names.items():
            if own == name:
                return role
        raise ValueError(f"no role is named {name!r}")


TEMPLATE = Template()


# --- writing

def next_state(template: Template, state: str, role: str) -> tuple[str, bool]:
    """The state after a turn, and whether the turn may follow."""
    return role, role in template.follows.get(state, ())


def format_turns(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """The segments of ``rows (conv_id, turn, role, text)``: conv_id, segment, text,
    loss, in_order.

    Rows of a conversation are in order of turn, then role, then text. Each gives three
    segments: head, text and tail, of which the text of some roles counts for the loss.
    ``in_order`` says whether the turn may follow the one before it; turns that may not
    are formatted too. A null text or role is an empty one; rows without conv_id are one
    conversation; rows without turn come first.
    """
    ordered = (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def write(batches):
        last, state, segment = object(), "", 0
        for batch in batches:
            out, held = [], 0
            for conv, role, text in zip(batch.column(0), batch.column(2), batch.column(3)):
                conv, role = conv.as_py(), role.as_py()
                if conv != last:
                    last, state, segment = conv, "", 0
                state, fits = next_state(template, state, role)
                parts = (
                    (template.opening(role), False),
                    (template.protected(text.as_py()), role in template.loss),
                    (template.tail, False),
                )
                for part, loss in parts:
                    out.append((conv, segment, part, loss, fits))
                    segment += 1
                    held += len(part)
                if held > PIECE:
                    yield _segments(out)
                    out, held = [], 0
            if out:
                yield _segments(out)

    return ordered.mapInArrow(
        write, "conv_id long, segment long, text string, loss boolean, in_order boolean"
    )


_SEGMENT = pa.schema([
    ("conv_id", pa.int64()), ("segment", pa.int64()), ("text", pa.string()),
    ("loss", pa.bool_()), ("in_order", pa.bool_()),
])


def _segments(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), _SEGMENT)],
        schema=_SEGMENT,
    )


# --- reading back

class Reader:
    """Reads a conversation from its formatted text, which comes in pieces, and the loss
    flag of each piece. Only the turn that is being read is held."""

    def __init__(self, template: Template):
        self.template = template
        before, _, after = template.head.partition("{role}")
        escape = re.escape(template.escape)
        inside = f"(?:{template._control().pattern})"
        self.turn = re.compile(
            f"{re.escape(before)}((?:{escape}.|[^{escape}:])*?){re.escape(after)}"
            f"((?:{escape}{inside}|(?!{re.escape(template.tail.strip())}|{escape}).)*?)"
            f"{re.escape(template.tail)}", re.S,
        )
        self.text, self.masked = "", []
        self.chars = self.turns = self.loss_chars = 0
        self.in_order, self.state = True, ""
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if loss:
            said = self.template.plain(text)
            self.loss_chars += len(said)
            self.loss_hash.update(said.encode())
        self.text += text
        if not self.text.endswith(self.template.tail):
            return
        at = 0
        while match := self.turn.match(self.text, at):
            role, said = self.template.role_of(match[1]), self.template.plain(match[2])
            self.turns_hash.update(f"{role}\n{said}\n".encode())
            self.turns += 1
            self.state, fits = next_state(self.template, self.state, role)
            self.in_order &= fits
            at = match.end()
        self.text = self.text[at:]

    def result(self) -> tuple:
        if self.text:
            raise ValueError(f"a conversation ends inside a turn: {self.text[:80]!r}")
        return (self.turns, self.turns_hash.hexdigest(), self.loss_chars,
                self.loss_hash.hexdigest(), self.chars, self.in_order)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, in_order boolean"
)


def read_back(segments: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation of ``segments``, read from the formatted text: DIGEST."""
    ordered = segments.select("conv_id", "segment", "text", "loss").repartition(
        "conv_id").sortWithinPartitions("conv_id", "segment")

    def read(batches):
        reader, conv = None, object()
        for batch in batches:
            done = []
            for own, text, loss in zip(batch.column(0), batch.column(2), batch.column(3)):
                own = own.as_py()
                if own != conv or reader is None:
                    if reader is not None:
                        done.append((conv, *reader.result()))
                    reader, conv = Reader(template), own
                reader.feed(text.as_py(), loss.as_py())
            yield _digests(done)
        yield _digests([] if reader is None else [(conv, *reader.result())])

    return ordered.mapInArrow(read, DIGEST)


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ("in_order", pa.bool_()),
])


def _digests(rows) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(_DIGEST)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, _DIGEST)], schema=_DIGEST
    )
