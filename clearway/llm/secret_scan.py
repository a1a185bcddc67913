"""Secrets in texts: fixed patterns, and strings that a primed compressor finds new where a secret is expected.

The patterns give the base spans. The method adds spans: a string of key characters that follows a sensitive word
closely is compressed behind its surroundings and a dictionary of identifiers. Words, names, paths and numbers already
seen there cost few bytes; a random key costs nearly its information content. Strings that cost at least
``MIN_BYTES_PER_CHAR`` are reported as ``novel``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import by_row, id_and_text, per_process

Span = tuple[str, int, int]

# The base patterns and the shortest match each reports.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

# Words after which a secret may stand, and how far.
SENSITIVE = re.compile(
    r"password|passwd|passphrase|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|authorization|bearer|client[ _-]?id|signature",
    re.ASCII | re.IGNORECASE,
)
# Each of them holds one of these, which are quicker to look for.
HINTS = ("passw", "passphrase", "secret", "token", "key", "credential", "authorization", "bearer", "client", "signature")
REACH = 64
# A string of key characters, this long. The parts of a run between "=" are candidates, with "=" as padding of their
# end; a run whose parts are all shorter is one as a whole.
LEAST_CHARS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}|[A-Za-z0-9+/_-]{15}={1,2}|[A-Za-z0-9+/_-]{14}==")
RUN = re.compile(r"[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{15,}")
TAIL = re.compile(r"(?<=[A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+")
SURROUNDINGS = 256
MIN_BYTES_PER_CHAR = 0.65

# Words that identifiers, paths and placeholders are made of; strings built from them compress behind this.
IDENTIFIERS = """
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 1111111111 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX 1234567890 9876543210
account action active address admin agent alias allow amount answer apply archive argument array article assert asset async attribute audio author auto
back balance bank base batch block body boolean branch bridge browser bucket buffer build button byte cache call cancel card category cell chain change
channel char check child class clean clear click client clone close cloud code collection color column command comment commit common compare complete
component compress compute condition config configuration confirm connect connection console constant container content context control convert cookie
copy core count country create currency current custom data database date debug decode default define delete delivery deploy description design detail
device dialog digest direct directory disable display document domain double download driver dump duplicate dynamic edit element email enable encode
encoder end engine entity entry enum environment equal error event example except execute exist expire export express extension external factory fail
feature fetch field file filter final find first flag float folder font force form format forward frame free from function game gateway generate generic
global google graph grid group guard handle handler hash head header height help hidden history home host http https image import index info init inner
input insert install instance integer interface internal invalid invoice item java javascript job join json keyboard kind label language large last latest
layer layout leaf left length level library license light limit line link list listener load local location lock login logout loop machine mail main
manager map mark mask master match memory menu merge message meta method metric minimum mobile mode model module monitor mount move name native network
next node none normal note notification null number object offer offset open operation operator option order organization origin output overlay owner
package page pair panel parameter parent parse partition password path pattern payment percent permission person phone photo picture placeholder plan
platform player plugin point policy port position post prefix press preview previous price primary print private process product profile program
progress project property protocol provider proxy public purchase query queue quick random range rate read ready record redirect reference refresh region
register release remote remove render repeat replace report request required reset resource response restore result return review right role root route
router rule run sample save scale scan schedule schema scope screen script search second secret section secure segment select send sequence serial
server service session setting settings setup shape share shell short show signature simple single size slot sort source space split stack stage standard
start state static status step stop storage store stream string strip style subject submit suffix summary support switch symbol sync syntax system table
target task template tenant test text thread threshold time timeout timestamp title token tool topic total trace track transaction transfer transform
transition translate transport tree trigger true type unique unit update upgrade upload url user username utility valid validate value variable vector
vendor verify version video view virtual visible visit wait warning watch web weight width window word worker workspace wrapper write year yellow zone
your_password_here your-api-key-here YOUR_SECRET_TOKEN change_me dummy test_token access_key_id secret_access_key client_id client_secret private_key
public_key refresh_token session_token authorization_header bearer credentials get_user_by_id set_value is_valid to_string max_tokens num_tokens
tokenizer api_version localhost www com org net io html yaml xml src/main/java lib/python usr/local/bin node_modules
""".strip().encode()


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; matches that are too short are dropped after matching."""
    spans: list[Span] = []
    lower = text.lower()
    # Lower-casing may lengthen a text but not lose these letters.
    if any(name in lower for name in ASSIGN_NAMES):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return spans


class Novelty:
    """Compressed size of a string behind its surroundings and the identifier dictionary."""

    def __init__(self, identifiers: bytes = IDENTIFIERS):
        self.identifiers = identifiers

    def marginal_bytes(self, around: bytes, candidate: bytes) -> int:
        primed = zstandard.ZstdCompressionDict(self.identifiers + b"\n" + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        options = zstandard.ZstdCompressionParameters.from_level(
            19, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        packer = zstandard.ZstdCompressor(dict_data=primed, compression_params=options)
        # The same surroundings go before both, so that only what the candidate adds is left.
        tail = around[-16:]
        return len(packer.compress(tail + candidate)) - len(packer.compress(tail))


def novel_spans(text: str, base: Iterable[Span], novelty: Novelty, least: float = MIN_BYTES_PER_CHAR) -> list[Span]:
    """Candidates within reach of a sensitive word whose marginal bytes per character reach ``least``.

    Strings inside a base span are known already; a candidate is looked at once however many words precede it.
    """
    lower = text.lower()
    if not any(hint in lower for hint in HINTS):
        return []
    taken = sorted((start, end) for _, start, end in base)
    candidates: list[tuple[int, int]] = []
    done = 0
    for word in SENSITIVE.finditer(text):
        done = max(done, word.end())
        # What goes on without a break belongs to a name or string that began before.
        if tail := TAIL.match(text, done):
            done = tail.end()
        # A run that starts within reach may end beyond: the window holds the shortest, then all of it is taken.
        for m in RUN.finditer(text, done, min(len(text), word.end() + REACH + LEAST_CHARS)):
            start, end = RUN.match(text, m.start()).span()
            if start < done:
                continue
            done = end
            candidates += [m.span() for m in CANDIDATE.finditer(text, start, end)] or [(start, end)]
    found: list[Span] = []
    for start, end in candidates:
        string = text[start:end]
        if any(s < end and start < e for s, e in taken):
            continue
        around = _surroundings(text, start, end).encode("utf-8", "replace")
        if novelty.marginal_bytes(around, string.encode()) >= least * len(string):
            found.append(("novel", start, end))
    return found


def _surroundings(text: str, start: int, end: int) -> str:
    """The text on both sides without repeats of the candidate, which would make it look known."""
    string = text[start:end]
    # One length more, so that no repeat is cut by the border.
    before = text[max(0, start - SURROUNDINGS - len(string)):start].replace(string, "")
    after = text[end:end + SURROUNDINGS + len(string)].replace(string, "")
    return before[-SURROUNDINGS:] + "\n" + after[:SURROUNDINGS]


def joined(spans: Iterable[Span]) -> str:
    """``kind:start:end`` by start, then kind in the order of ``KINDS``, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


FOUND = pa.schema([
    ("doc_id", pa.int64()),
    ("found", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))),
])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_BYTES_PER_CHAR) -> DataFrame:
    """doc_id and ``found``, the spans (kind, start, end in code points, text) of every document in their order.

    Documents without secrets, null and empty texts have an empty list. Every row is scanned as a whole.
    """

    def one(doc, text):
        base = base_spans(text)
        spans = base + novel_spans(text, base, per_process("novelty", Novelty), least)
        spans.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
        return doc, [{"kind": k, "start": s, "end": e, "text": text[s:e]} for k, s, e in spans]

    return id_and_text(docs, id_col, text_col).mapInArrow(
        by_row(one, ["id", "text"], FOUND), "doc_id long, found array<struct<kind: string, start: long, end: long, text: string>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, from the rows of ``find_secrets``."""

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text_of(items):
        return F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("novel"),
        F.sha2(text_of(F.filter("found", lambda x: x["kind"] != "novel")), 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"),
    )


def repeats(text: str, found: Iterable[Span]) -> Iterator[tuple[int, int]]:
    """Where else a text has the strings that were found in it, in one pass however many there are."""
    strings = {text[s:e] for kind, s, e in found if kind != "assign"}
    strings |= {m[2] for kind, s, e in found if kind == "assign" and (m := ASSIGN.match(text, s)) and len(m[2]) >= LEAST_CHARS}
    if strings:
        automaton = ahocorasick.Automaton()
        for string in strings:
            automaton.add_word(string, len(string))
        automaton.make_automaton()
        for last, length in automaton.iter(text):
            yield last + 1 - length, last + 1


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", least: float = MIN_BYTES_PER_CHAR) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; overlapping spans become one mark. Null texts stay null, all columns stay.

    What was found once is replaced wherever else the same text has it: keys, digests and novel strings, and assigned values as long as those.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        novelty = per_process("novelty", Novelty)

        def one(text):
            if text is None:
                return None
            base = base_spans(text)
            found = base + novel_spans(text, base, novelty, least)
            spans = sorted({*((s, e) for _, s, e in found), *repeats(text, found)})
            parts, at = [], 0
            for start, end in spans:
                if start >= at:
                    parts += [text[at:start], mark]
                at = max(at, end)
            return "".join([*parts, text[at:]]) if spans else text

        return texts.map(one)

    return docs.withColumn(text_col, clean(F.col(text_col)))
