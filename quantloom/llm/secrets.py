"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

Base spans come from three patterns. Novelty adds spans: a candidate is a run of 16 or more token
characters with at least two of lower case, upper case and digits, with a sensitive word within
`context` characters before it. Of a run KEY=value, where the value has 16 characters or more, the
value is the candidate, and a sensitive word in KEY counts as well. Its marginal size is the compressed size of surroundings plus
candidate less that of the surroundings alone, both primed with a dictionary of identifiers, words
of code and the surroundings' kind. Words, identifiers and repeats of what stands around cost few
bytes; random strings cost nearly their entropy. A candidate of `bits` or more per character whose
span meets no base span is reported as `novel`. The costs of 16 to 24 random characters and of as long a mixed-case
identifier of several words overlap; `bits` is set so that random ones are caught, so some such identifiers are reported too.

Positions count code points; ends are exclusive. Matches are leftmost and do not overlap within a
kind; kinds may overlap each other.

Edge cases: null texts count as empty and have no spans; whole texts are scanned, of any length;
repeated rows each get their row; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The patterns of the base kinds, in their order.
ASSIGN = re.compile(
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Words near which a token is sensitive.
SENSITIVE = re.compile(r"(?i)password|passwd|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private|signature|session|cookie|aws|ssh")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")

#: What the compressor knows before it sees a text.
IDENTIFIERS = (
    "abstract access account action address admin algorithm amount analysis application argument array attribute authorization available background "
    "boolean boundary buffer builder button callback category certificate channel character checksum classification client collection column command "
    "comment component condition config configuration connection constructor container content context controller conversion coordinate counter "
    "create current customer database dataset datetime default definition delete dependency description destination development device dictionary "
    "dimension directory document domain download duration element encoding endpoint environment error event example exception execute exception "
    "expression extension external factory feature field file filter format function generator global group handler header height history identifier "
    "image implementation import index information initialize input instance integer interface internal iterator javascript key label language layout "
    "length library license listener location logger manager mapping master material maximum measurement memory message metadata method minimum model "
    "module network notification number object operation option order output override package page parameter parent parser password path pattern "
    "payload performance permission pointer policy position prefix previous primary private process product production profile project property "
    "protocol provider public python query random range record reference register registry relation release remote repository request resource "
    "response result return schedule schema scope script search section security selector sequence serialize server service session setting signature "
    "simple size source specification statement static status storage string structure style submit subscription suffix summary system table target "
    "template temporary terminal thread timeout timestamp token tracking transaction transform translation type undefined unique update upload user "
    "username utility validation value variable vector version visible warning website width window workflow workspace "
    "https://www.example.com/index.html http:// localhost 127.0.0.1 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "00000000-0000-0000-0000-000000000000 getElementById setAttribute toString application/json Content-Type charset=utf-8 self.assertEqual "
    "import os\nimport sys\ndef __init__(self, public static void main(String[] args) return null; const let var function() { if (err) throw "
    'token = "" password = "" secret: api_key= access_key_id secret_access_key Authorization: Bearer '
).encode()


#: Camel case knows the words as well.
DICTIONARY = b" ".join(w.capitalize() for w in IDENTIFIERS.split() if w.isalpha()) + b" " + IDENTIFIERS


class Novelty:
    """Marginal compressed sizes, primed with a dictionary."""

    def __init__(self, dictionary: bytes = DICTIONARY, level: int = 19):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def bits(self, around: bytes, candidate: bytes) -> float:
        """Bits per byte that the candidate adds to its surroundings."""
        alone = len(self.compressor.compress(around))
        return 8 * (len(self.compressor.compress(around + candidate)) - alone) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _joint(taken: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(taken):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _value(run: str) -> int:
    """Where the value of a run KEY=value starts, if that leaves 16 characters; 0 for other runs. Padding at the end is the value's."""
    at = run.rstrip("=").rfind("=") + 1
    return at if len(run) - at >= 16 else 0


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty, bits: float, context: int) -> list[tuple[int, int, str]]:
    """Each run is judged once, however many sensitive words stand near it."""
    near = [m.end() for m in SENSITIVE.finditer(text)]
    if not near:
        return []
    found = []
    starts, ends = _joint(taken)
    for m in TOKEN.finditer(text):
        begin, end = m.span()
        start = begin + _value(m[0])
        k = bisect.bisect_right(near, begin)
        close = k and begin - near[k - 1] <= context
        if not close and not (start > begin and SENSITIVE.search(text, begin, start)):
            continue
        k = bisect.bisect_right(ends, start)
        if k < len(starts) and starts[k] < end:
            continue
        run = text[start:end]
        if sum(any(map(f, run)) for f in (str.islower, str.isupper, str.isdigit)) < 2:
            continue
        around = text[max(0, start - context) : start] + text[end : end + context]
        if novelty.bits(around.encode("utf-8", "replace"), run.encode()) >= bits:
            found.append((start, end, "novel"))
    return found


def spans(text: str | None, novelty: Novelty, bits: float = 5.0, context: int = 80) -> list[tuple[int, int, str]]:
    """All spans of a text: (start, end, kind) by start, then kind."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty, bits, context), key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame, bits: float = 5.0, context: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = spans(text, novelty, bits, context)
                base = [s for s in found if s[2] != "novel"]
                rows.append([*(sum(s[2] == k for s in found) for k in KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)])
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    return common.ids_and_texts(docs, id_col, text_col).mapInArrow(
        common.trimmed(run),
        "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string",
    )


def redact(text: str, found: list[tuple[int, int, str]], mark: str = "[{}]") -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced as one, by the first's."""
    out, at = [], 0
    merged: list[list] = []
    for start, end, kind in found:
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in merged:
        out += [text[at:start], mark.format(kind)]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, bits: float = 5.0, context: int = 80, text_col: str = "text") -> DataFrame:
    """The rows of docs, with secrets in texts replaced by their kind; null texts stay null, other columns as they are."""

    def run(batches):
        novelty = Novelty()
        for texts in batches:
            yield texts.map(lambda t: t if not t else redact(t, spans(t, novelty, bits, context)), na_action="ignore")

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from common.trimmed(run)(batches)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
