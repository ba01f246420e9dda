"""Credentials embedded in source text: found by how unnatural a string is and by its context, and redacted in place.

Every string-like run is measured in characters per subword of a public vocabulary: language needs few
subwords, random strings many. The context then says how natural a value may be to count (``LIMITS``):
without a name that tells of a secret only strings that no language has count, after the name of a
token those that are not language, and where a password stands all but plain words.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm import transducer
from stratagraph.session import spread

# Words that end the name of a setting that holds a secret, by how much the name alone says.
PASSWORD_ENDS = "password passwd pwd pass passphrase passcode pw pin pinsecret kennwort passwort losung motdepasse clave contrasena contraseña senha parola wachtwoord unlockword credential credentials"
TOKEN_ENDS = "secret token apikey servicekey licencekey licensekey hmackey accesskey secretkey privatekey signingkey encryptionkey masterkey accountkey storagekey sharedkey authkey deploykey adminkey sessionkey clientkey bearer authtoken apitoken jwt"
ENCODED_ENDS = "b64 base64 encoded enc plain value text"
#: Beginnings and forms of well-known tokens.
KNOWN = r"gh[pousr]_\w{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|AIza[\w-]{30,}|[sr]k_(?:live|test)_\w{16,}|xox[abprs]-[\w-]{20,}|npm_\w{30,}|pypi-[\w-]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}"
#: Contents that stand for a secret without being one.
STAND_INS = r"your[-_ ]?\w|change[-_ ]?me|replace[-_ ]?me|replace[-_ ]?this|insert[-_ ]|place[-_ ]?holder|redacted|removed|masked|hidden|dummy|example|sample|todo|tbd|fixme|fill[-_ ]?in|none$|null$|nil$|true$|false$|undefined$|empty$|test$|secret$|password$|token$|string$"

#: Words that sentences are made with and passphrases are not.
FUNCTION_WORDS = frozenset("a an the your you my our his her its this that these those is are was were be been must may can will shall should would not no of for from to in on at by with as if or and but when then than enter choose confirm reset forgot invalid wrong missing required please use set get see at least most".split())
#: What the name of a value says that is random but open: ids, checksums, public halves of keys, pictures.
OPEN_NAMES = re.compile(r"(?:^|[_.-])u?u?id$|Id$|ID$|uuid|guid|hash|sha\d|md5|digest|checksum|crc|integrity|etag|commit|revision|nonce|salt|public|cert|fingerprint|signature|icon|image|img|png|thumbnail|pixel|blob|version|url|uri|path|file", re.I)

_ENDS = re.compile(rf"(?:^|.*?)(?P<end>{'|'.join(sorted((PASSWORD_ENDS + ' ' + TOKEN_ENDS).split(), key=len, reverse=True))})(?:{ENCODED_ENDS.replace(' ', '|')}|\d)*$")
_PASSWORDS = frozenset(PASSWORD_ENDS.split())
_NOT_SECRET = re.compile(r"public|fingerprint|hash$|digest$|compass$|bypass$|spawn|tokenpass")
_KNOWN = re.compile(rf"(?<![\w/+-])(?:{KNOWN})(?![\w/+])")
_STAND_IN = re.compile(rf"^(?:{STAND_INS})|^<[^>]*>$|^\W*$|^([xX*.#?_-])\1+$|^x{{4,}}|^\[[^\]]*\]$", re.I)
_REFERENCE = re.compile(r"\$\{|\$\(|^\$\w|\{\{|\}\}|^%\w+%?$|%\(|%s|^\{\w*\}$|process\.env|environ|getenv|\benv[.(\[]|ENV\[|^vault:|^env:|^secret:|^ref:|^arn:|^ssm:|^file:|^@\w+$|^:\w+$|^!\w", re.I)
_HEADER_OF_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END_OF_KEY = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=]{16,}")
_URL = re.compile(r"(?<![A-Za-z0-9+.-])(?:(?!\b[A-Za-z])[A-Za-z0-9+.-])*+[A-Za-z][A-Za-z0-9+.-]*+://(?P<user>[^\s:/@'\"`<>]*):(?P<v>[^\s@'\"`]+?)@(?=[\w\[$\{-])")
_QUERY = re.compile(r"[;?&](?:password|passwd|pwd|pass|secret|token|access_token|api_key|apikey|sig)=(?P<v>[^;&\s\"'`]+)", re.I)
_BASIC = re.compile(r"\bBasic\s+(?P<v>[A-Za-z0-9+/]{6,}={0,2})")
_BEARER = re.compile(r"\bBearer\s+(?P<v>[A-Za-z0-9_.~+/=-]{12,})")
_Q = r"(?:\"(?P<v{0}a>[^\"\n]+)\"|'(?P<v{0}b>[^'\n]+)'|`(?P<v{0}c>[^`\n]+)`)"
_CALLS = [
    re.compile(r"\b(?:auth|SetBasicAuth|basicAuth|login|signIn|authenticate)\s*=?\s*\(?\(\s*(?:\"[^\"\n]*\"|'[^'\n]*')\s*,\s*" + _Q.format(0) + r"\s*[,)]", re.I),
    re.compile(r"\b(?:\w*connect(?:ion)?|createConnection)\s*\(\s*(?:\"[^\"\n]*\"|'[^'\n]*')\s*,\s*(?:\"[^\"\n]*\"|'[^'\n]*')\s*,\s*" + _Q.format(1) + r"\s*[,)]", re.I),
    re.compile(r"\bsshpass\s+-p\s*(?:" + _Q.format(2) + r"|(?P<v2d>[^\s'\"]+))"),
    re.compile(r"\b(?:LOGIN\s+|WITH\s+)?(?:PASSWORD|IDENTIFIED\s+BY)\s+" + _Q.format(3), re.I),
    re.compile(r"--(?:password|passwd|token|secret|api-key)[= ](?:" + _Q.format(4) + r"|(?P<v4d>[^\s'\"]+))", re.I),
    re.compile(r"\bcurl\b[^\n]*?\s(?:-u|--user)\s*['\"]?[\w.@-]+:(?P<v5d>[^\s'\"]+)"),
    re.compile(r"\blogin\s+\S+\s+password\s+(?P<v6d>\S+)", re.I),
    re.compile(r"\blog(?:s|ged)?[\s-]?in\s+(?:was|is|as|with|data:?)\s+[\w.@-]+(?::|\s*/\s*)(?P<v7d>[^\s/]+)", re.I),
    re.compile(r"\b(?:credentials?|account|user)\s*(?:was|is|are|:)\s+[\w.@-]+\s*/\s*(?P<v8d>[^\s/]+)", re.I),
]
#: name, what joins it to a value, and the value: quoted, possibly in a call, or the first character of a bare one. A name
#: begins at the first letter of its run of name characters, so that each run is read once.
_ASSIGNED = re.compile(
    r"(?<![\w.-])(?:(?![A-Za-z_])[\w.-])*+(?P<k>[A-Za-z_][\w.-]*+)[\"'`]?\]?\s*(?:\?\?=|\|\|=|:=|=>|==?|:|,|\()\s*"
    r"(?:(?:\[\]byte|bytes|String|str|Secret|new \w+|SecretStr|quote)?\s*\(\s*)?[bru]?"
    r"(?:\"(?P<a>[^\"\n]+)\"|'(?P<b>[^'\n]+)'|`(?P<c>[^`\n]+)`|(?P<d>[^\s\"'`(){}\[\],;<>]))"
)
#: A bare value, and what stands after it: the end of the line or a comment.
_BARE = re.compile(r"[^\s\"'`(){}\[\],;<>]++")
_BARE_END = re.compile(r"\s*(?:[,;]?\s*$|\s(?:#|//))")
_TAG = re.compile(r"<(?P<k>[A-Za-z][\w.-]*)>(?P<a>[^<\n]+)</")
_TYPED = re.compile(r"(?<!\w)(?:(?![A-Za-z_])\w)*+(?P<k>[A-Za-z_]\w*+)\s*:\s*[A-Za-z][\w<>\[\], |.]*?\s=\s*(?:\"(?P<a>[^\"\n]+)\"|'(?P<b>[^'\n]+)'|`(?P<c>[^`\n]+)`)")
_MORE = re.compile(r"^[+ -]?\s*(?P<plus>[+.]\s*)?[bru]?(?:\"(?P<a>[^\"\n]*)\"|'(?P<b>[^'\n]*)'|`(?P<c>[^`\n]*)`)")
#: At least one of these stands, as ``_flat`` gives it, in every line that can hold a secret by the rules here: all ends of
#: names, and for each other pattern a piece that none of its matches is without.
SUSPECTS = (PASSWORD_ENDS + " " + TOKEN_ENDS).split() + (
    "://|sig=|basic|auth|login|log in|logsin|logs in|loggedin|logged in|signin|connect|identified|curl|account|user |user:|userwas|useris|userare|private key|"
    "ghp|gho|ghu|ghs|ghr|githubpat|glpat|akia|asia|aiza|sklive|sktest|rklive|rktest|xox|npm|pypi|sg.|eyj|\u0131|\u017f"
).split("|")
_DROPPED = str.maketrans({c: None for c in "0123456789_-"} | {c: " " for c in "\t\r\v\f\x1c\x1d\x1e\x1f"})
_FOREIGN = re.compile(r"[^\x00-\x7f\u00f1\u0131\u017f]+")


def _machine():
    """One automaton for all suspects, if the library is there; else a pattern."""
    try:
        import ahocorasick
    except ImportError:
        return re.compile("|".join(map(re.escape, SUSPECTS)))
    made = ahocorasick.Automaton()
    for i, word in enumerate(SUSPECTS):
        made.add_word(word, i)
    made.make_automaton()
    return made


def _flat(text: str) -> str:
    """Lower case without what ``Finder.named`` skips in names: digits, '_', '-' and foreign letters; line feeds stay.

    The two foreign letters that patterns without case take for 'i' and 's' stay as well; they are suspects themselves.
    """
    low = text.lower()
    return (low if low.isascii() else _FOREIGN.sub("", low)).translate(_DROPPED)


#: The most characters per subword of a value that counts, by its context. ``None`` is no context at all, where a value must
#: also have ``EXCESS`` subwords more than language of its length.
LIMITS = {None: 2.2, "token": 3.4, "header": 3.4, "password": 5.5, "passphrase": 9.0, "login": 5.5, "address": 5.5, "private key": 3.4}
EXCESS = 8.0
#: Runs of letters of both cases and digits, which stand alone. Fewer than 12 characters can't have the excess.
_MIXED = re.compile(r"(?<![\w/+.%@-])(?=[a-zA-Z_-]*+[0-9])(?=[a-z0-9_-]*+[A-Z])(?=[A-Z0-9_-]*+[a-z])[A-Za-z0-9_-]{12,}+(?![\w/+=.%@])")
_NAME_BEFORE = re.compile(r"([A-Za-z_][\w.-]*+)[\"'`]?\]?\s*(?:\?\?=|:=|=>|==?|:|\()\s*(?:\[\]byte\(|[A-Za-z]\w*\()?\s*[\"'`]?$")


@dataclass(frozen=True)
class Secret:
    """A secret value in a text: its place in characters, the line it begins in (from 1), its kind and its characters per subword."""

    start: int
    end: int
    line_no: int
    kind: str
    score: float = 0.0
    #: Places of the rest of a value that is put together from several lines.
    parts: tuple[tuple[int, int], ...] = ()


class Finder:
    """Finds secrets by names, positions and the number of characters per subword of their values."""

    def __init__(self, encode, natural: float = 3.4, kept: int = 200_000):
        #: encode gives the subwords of a text; below ``natural`` characters per subword a string is no language.
        self.encode, self.natural, self.machine = encode, natural, _machine()
        #: Measures already made, up to ``kept``; only work is saved by it.
        self.measured, self.kept = {}, kept

    def subwords(self, value: str) -> int:
        n = self.measured.get(value)
        if n is None:
            n = max(1, len(self.encode(value)))
            if len(self.measured) < self.kept and len(value) < 200:
                self.measured[value] = n
        return n

    def score(self, value: str) -> float:
        """Characters per subword."""
        return len(value) / self.subwords(value)

    def nameless(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Line (from 0) to places, within it, of strings so unnatural that no name is needed.

        They are the value of a setting or the only argument of a call; items of lists and rows of tables
        are data. What is named as an id, a checksum, a public key or a picture is open, however random it is.
        """
        found: dict[int, list[tuple[int, int]]] = {}
        for m in _MIXED.finditer(text):
            value = m[0]
            n = self.subwords(value)
            if len(value) >= LIMITS[None] * n or n - len(value) / self.natural < EXCESS or _STAND_IN.search(value):
                continue
            begin = text.rfind("\n", 0, m.start()) + 1
            before, after = text[begin : m.start()], text[m.end() : m.end() + 1]
            quoted = before[-1:] in ("\"", "'", "`") and after == before[-1]
            if not quoted and not (re.search(r"[\w\"'`\]]\s*[=:]\s*$", before) and (after in ("", "\n", "\r", ";", ",") or text[m.end() : m.end() + 2] in (" #", " /"))):
                continue
            name = _NAME_BEFORE.search(before)
            if name is None or (OPEN_NAMES.search(name[1]) or _NOT_SECRET.search(name[1].lower())):
                continue
            found.setdefault(text.count("\n", 0, begin), []).append((m.start() - begin, m.end() - begin))
        return found

    def suspects(self, text: str) -> list[int]:
        """Numbers (from 0) of the lines in which something stands that lines with secrets have."""
        flat = _flat(text)
        places = [end for end, _ in self.machine.iter(flat)] if hasattr(self.machine, "iter") else [m.start() for m in self.machine.finditer(flat)]
        if not places:
            return []
        starts = [0, *accumulate(len(x) + 1 for x in flat.split("\n"))]
        return sorted({bisect_right(starts, p) - 1 for p in places})

    def unnatural(self, value: str) -> bool:
        return len(value) < self.natural * self.subwords(value)

    def stands_in(self, value: str) -> bool:
        return bool(_STAND_IN.search(value) or _REFERENCE.search(value))

    def words_only(self, value: str) -> bool:
        """Plain words, paths of words and dotted names: nothing that one would choose as a secret."""
        return bool(re.fullmatch(r"[A-Za-zÀ-ÿ]+(?:[-_./: ]+[A-Za-zÀ-ÿ]+)*[.!?:]?", value)) and not self.unnatural(re.sub(r"[-_./:]", " ", value))

    def passphrase(self, value: str) -> bool:
        """Three or more words that make no sentence."""
        words = value.split(" ")
        return len(words) >= 3 and all(re.fullmatch(r"[\w'-]+", w) for w in words) and FUNCTION_WORDS.isdisjoint(w.lower() for w in words)

    def secret_value(self, value: str, password: bool, bare: bool = False) -> bool:
        """Whether a value that stands where a secret would stand is one that could be used."""
        value = value.strip()
        if password and " " in value and not self.stands_in(value):
            return self.passphrase(value)
        if len(value) < (4 if password else 8) or self.stands_in(value) or " " in value or self.words_only(value):
            return False
        if re.fullmatch(r"(?:[\w.-]+/)+[\w.-]+", value) and not re.search(r"\d|[A-Z]", value):
            return False
        if bare and (re.fullmatch(r"\d+(?:\.\d+)?", value) or re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", value) and not self.unnatural(value)):
            return False
        if password:
            return True
        return not value.isdigit() and (bool(_KNOWN.fullmatch(value)) or self.unnatural(value))

    def named(self, key: str) -> str | None:
        """'password' or 'token' if a name says that it holds one."""
        flat = re.sub(r"[^a-zñ]|(?<=\W)\d+", "", key.rpartition(".")[2].lower())
        if _NOT_SECRET.search(flat):
            return None
        m = _ENDS.match(flat) or _ENDS.match(re.sub(r"(?:b|base)$", "", flat))
        return None if m is None else "password" if m["end"] in _PASSWORDS else "token"

    def _whole(self, lines: list[str], n: int, match: re.Match, group: str) -> tuple[str, list[tuple[int, int, int]]] | None:
        """The value with the parts of a string that goes on in the next lines, and their places; None if they are missing."""
        value, parts, rest = match[group], [], lines[n][match.end() :].strip()
        opened = re.search(r"[=:]\s*\(\s*[bru]?$", lines[n][: match.start(group) - 1]) is not None

        def follows(i: int, joined: bool) -> re.Match | None:
            more = _MORE.match(lines[i]) if i < len(lines) else None
            return more if more and (joined or opened or more["plus"]) else None

        joined = rest in ("+", "\\", ".", "..")
        while joined or (rest == "" and follows(n + 1, False)):
            n += 1
            more = follows(n, joined)
            if more is None:
                return None
            value += more[more.lastgroup]
            parts.append((n, *more.span(more.lastgroup)))
            rest = lines[n][more.end() :].strip()
            joined = rest in ("+", "\\", ".", "..")
        return None if rest == "" and opened and not parts else (value, parts)

    def in_line(self, lines: list[str], n: int) -> Iterator[tuple]:
        """(start, end, kind) of the secrets that begin in a line, with the places of parts in later lines if it has any.

        Bare values, which are marked by a None, are still to be judged.
        """
        line = lines[n]
        for m in _URL.finditer(line):
            if not self.stands_in(m["v"]) and not self.words_only(m["v"]):
                yield *m.span("v"), "address"
        for m in _QUERY.finditer(line):
            if not self.stands_in(m["v"]) and len(m["v"]) >= 4:
                yield *m.span("v"), "address"
        for m in _BASIC.finditer(line):
            try:
                user, colon, value = base64.b64decode(m["v"], validate=True).decode("utf-8").partition(":")
            except ValueError:
                continue
            if colon and value and not self.stands_in(value):
                yield *m.span("v"), "header"
        for m in _BEARER.finditer(line):
            if self.secret_value(m["v"], False):
                yield *m.span("v"), "header"
        for m in _KNOWN.finditer(line):
            if not self.stands_in(m[0]):
                yield *m.span(), "token"
        for call in _CALLS:
            for m in call.finditer(line):
                name = m.lastgroup
                value = m[name]
                if len(value) >= 4 and not self.stands_in(value) and not self.words_only(value):
                    yield *m.span(name), "login"
        for pattern in (_ASSIGNED, _TYPED, _TAG):
            at = stop = 0
            # Values are looked into again: a name may itself stand where a value would.
            while m := pattern.search(line, at):
                at = m.end("k")
                kind = self.named(m["k"])
                group = m.lastgroup
                if kind is None or group == "k":
                    continue
                if group == "d":
                    if m.end("d") > stop:
                        stop = _BARE.match(line, m.start("d")).end()
                        ends = _BARE_END.match(line, stop) is not None
                    if ends:
                        yield m.start("d"), stop, kind, None
                    continue
                whole = self._whole(lines, n, m, group)
                if whole is not None and self.secret_value(whole[0], kind == "password"):
                    yield *m.span(group), kind, *whole[1]

    def find(self, text: str) -> list[Secret]:
        """The secrets of a whole text, in order; lines end at the line feed."""
        nameless = self.nameless(text)
        suspects = sorted({*self.suspects(text), *nameless})
        if not suspects:
            return []
        lines = text.split("\n")
        found: list[Secret] = []
        starts = [0, *accumulate(len(x) + 1 for x in lines)]
        inside, ahead = -1, []
        for n in suspects:
            if n <= inside:
                continue
            line, offset = lines[n], starts[n]
            if m := _HEADER_OF_KEY.search(line):
                span = self._private_key(lines, n, m)
                if span is not None:
                    inside, length = span
                    found.append(Secret(offset + m.start(), offset + m.start() + length, n + 1, "private key", self.score(text[offset + m.end() : offset + m.start() + length])))
                continue
            lines[n] = line.rstrip("\r")
            spans = sorted(set(self.in_line(lines, n)), key=lambda x: (x[:3], x[3:] == (None,), x[3:]))
            lines[n] = line
            end, ahead = -1, [p for p in ahead if p[1] > offset]
            for start, stop, kind, *parts in spans:
                # What lies in another secret needn't be judged.
                if start >= end and (parts != [None] or self.secret_value(line[start:stop], kind == "password", True)):
                    parts = [] if parts == [None] else parts
                    value = line[start:stop] + "".join(lines[i][a:b] for i, a, b in parts)
                    kind, score = "passphrase" if kind == "password" and " " in value.strip() else kind, self.score(value)
                    if score < LIMITS[kind]:
                        found.append(Secret(offset + start, offset + stop, n + 1, kind, score, tuple((starts[i] + a, starts[i] + b) for i, a, b in parts)))
                        ahead += [(offset + start, offset + stop), *found[-1].parts]
                        end = stop
            for start, stop in nameless.get(n, ()):
                # Parts of a value that began in an earlier line belong to it.
                if all(offset + stop <= a or offset + start >= b for a, b in ahead):
                    found.append(Secret(offset + start, offset + stop, n + 1, "unnatural", self.score(line[start:stop])))
        return found

    def _private_key(self, lines: list[str], n: int, match: re.Match) -> tuple[int, int] | None:
        """(last line, length in characters) of a private key with a body, else None."""
        line = lines[n]
        if end := _END_OF_KEY.search(line, match.end()):
            return (n, end.end() - match.start()) if _KEY_BODY.search(line[match.end() : end.start()].replace("\\n", " ")) else None
        last, body = n, False
        for i in range(n + 1, len(lines)):
            if _END_OF_KEY.search(lines[i]):
                last = i
                break
            if not re.fullmatch(r"[+ -]?\s*(?:#|//|--|\*|;)?\s*[\"']?(?:[A-Za-z0-9+/=]+|[A-Za-z-]+: .*)?(?:\\n)?[\"']?\s*[+\\]?\r?", lines[i]):
                break
            body = body or _KEY_BODY.search(lines[i]) is not None
            last = i
        if not body:
            return None
        length = len(line) - match.start() + sum(len(x) + 1 for x in lines[n + 1 : last + 1])
        return last, length


def redacted(text: str, secrets: list[Secret]) -> str:
    """The text with each secret's characters replaced by '*', line ends kept: every other offset stays."""
    out, at = [], 0
    for start, end in sorted({p for s in secrets for p in ((s.start, s.end), *s.parts)}):
        out += [text[at:start], re.sub(r"[^\r\n]", "*", text[max(at, start) : end])]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _fields(files: DataFrame, key: str, fields: list[str]) -> DataFrame:
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]
    return spread(files.select(key, *fields)).select(F.col(key).alias("key"), F.explode(F.array(*parts)).alias("f")).select("key", "f.field", "f.text").where("text is not null and text != ''")


def _finder(folder: str, name: str) -> Finder:
    return Finder(transducer.load(folder, name).encode)


def find_secrets(files: DataFrame, key: str, fields: list[str], folder: str = transducer.FOLDER, name: str = transducer.NAME) -> DataFrame:
    """Secrets of text fields: ``key``, field, line_no, start, length (characters from 0), kind and score; no shuffle.

    ``score`` is the characters per subword of the value, by which, with its context, it was judged.
    Null and empty fields have none; a text is read whole; repeated rows give repeated rows.
    """
    schema = f"key {files.schema[key].dataType.simpleString()}, field string, line_no bigint, start bigint, length bigint, kind string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(folder, name).find
        for batch in batches:
            rows = [(i, s.line_no, s.start, s.end - s.start, s.kind, s.score) for i, text in enumerate(batch.column(2)) for s in find(text.as_py())]
            at, line_no, start, length, kind, score = zip(*rows) if rows else ([],) * 6
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line_no, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(kind, pa.string()), pa.array(score, pa.float64())], names=["key", "field", "line_no", "start", "length", "kind", "score"])

    return _fields(files, key, fields).mapInArrow(run, schema).withColumnRenamed("key", key)


def redact_secrets(files: DataFrame, key: str, fields: list[str], folder: str = transducer.FOLDER, name: str = transducer.NAME) -> DataFrame:
    """Fields that held secrets, without them: ``key``, field, secrets (their number) and text of the same length."""
    schema = f"key {files.schema[key].dataType.simpleString()}, field string, secrets int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(folder, name).find
        for batch in batches:
            rows = [(i, len(found), redacted(text.as_py(), found)) for i, text in enumerate(batch.column(2)) if (found := find(text.as_py()))]
            at, counts, texts = zip(*rows) if rows else ([], [], [])
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], names=["key", "field", "secrets", "text"])

    return _fields(files, key, fields).mapInArrow(run, schema).withColumnRenamed("key", key)
