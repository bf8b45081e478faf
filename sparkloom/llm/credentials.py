"""Credentials in source code, configuration and notes: where they stand, and the texts without them.

Method. A text is read for literals in the places where credentials are written (assignments to telling names in any
notation, addresses with a password, authorization headers, command flags, key blocks, self-describing tokens). Encoded
literals (base64, hex, percent and backslash escapes) are decoded and what they hold is read in the same way, layer by
layer; every layer is shorter than the one around it, so this ends by itself. Decoded bytes are parsed as key
containers by their grammar (DER of PKCS#1, PKCS#8, SEC1 and PKCS#12; the OpenSSH format). A find inside an encoded
literal is redacted by encoding the redacted content again, so the literal stays well-formed.

A text is one unit of work and there is no shuffle. Masked values, placeholders, references to variables, files or
stores, hashes and public keys are no credentials.
"""

from __future__ import annotations

import base64
import binascii
import re
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "REDACTED"

# --- names -----------------------------------------------------------------------------------------------------------
#: Words of a name that say that its value is a credential.
WORDS = {"password", "passwd", "passwort", "passphrase", "passcode", "kennwort", "pwd", "secret", "token", "apikey", "accesskey", "secretkey", "privatekey", "credential", "clave", "contrasena", "contraseña", "mdp", "jeton"}
#: Words that count only at the end of a name.
LAST_WORDS = {"pass", "auth", "authorization", "credentials"}
#: Words before "key" that make it a credential.
KEY_OF = {"api", "access", "signing", "encryption", "private", "secret", "auth", "master", "storage", "account", "webhook", "client", "service", "deploy", "ssh", "hub", "app", "license", "jwt", "hmac", "shared", "aes", "session"}
#: Words after it with which the value is something about the credential.
ABOUT = set(
    "hash hashes digest sha256 md5 checksum fingerprint id ids ref refs reference file files path dir env var name names url uri endpoint host limit limits count counts budget max min len length size"
    " ttl expiry expires expired expiration timeout required enabled disabled type kind policy rule rules field label prefix suffix public hint index usage total rate header algorithm alg version age"
    " store provider manager bucket position at on line row status state valid verified".split()
)
#: Words before it that do the same.
ABOUT_BEFORE = {"max", "min", "num", "total", "public", "pub", "n", "is", "has", "no"}

KEYWORD = re.compile(r"pass|pwd|kennwort|secret|token|key|auth|cred|clave|contrase|mdp|jeton|mot de passe", re.I)
NAME_LEFT = re.compile(r"[\w.\-]{0,80}\Z")
NAME_RIGHT = re.compile(r"[\w.\-]{0,80}")


@lru_cache(maxsize=100_000)
def telling(name: str) -> bool:
    """Whether a variable, member or flag of this name holds a credential."""
    parts = [p for p in re.split(r"[_\-.]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()) if p]
    at = -1
    for i, p in enumerate(parts):
        if p in WORDS or (p == "key" and i and parts[i - 1] in KEY_OF) or (p in LAST_WORDS and i == len(parts) - 1):
            at = i
    if at < 0:
        return False
    return not (set(parts[at + 1 :]) & ABOUT or set(parts[:at]) & ABOUT_BEFORE)


# --- values ----------------------------------------------------------------------------------------------------------
PLACEHOLDER = re.compile(
    r"""[*x.•#_\-=?]+ | <.*> | \[.*\] | \{.*\} | \(.*\)
    | (?:your|my|the|insert|enter|put|replace|change|example|sample|dummy|todo|tbd|fixme|placeholder|redacted|masked|hidden|removed|secret|password|passwd|token|none|null|nil
       |undefined|empty|unset|default|true|false|yes|no|n/?a|str|string|optional)(?:[ _\-]*[a-z]+)*[.!]?""",
    re.I | re.X | re.S,
)
REFERENCE = re.compile(
    r"""\$ | % [A-Za-z_(] \w* [%)] | \{\{ | <% | @ | ~?/ | \.{1,2}/ | [A-Za-z]:\\ | (?:vault|env|file|ssm|secretsmanager|keyring|op|kv|secret|arn|ref|https?|s3|gs):
    | (?:process|os|env|environ|system|config|settings|self|this|vault|secrets|app|ctx|request|req|args|options)\.[A-Za-z_] | [A-Za-z_][\w.]*\( | [A-Za-z_]\w*\[["'\w] | !\w+ | -----BEGIN
    | (?:new|await|yield|lambda|function|async)\s""",
    re.I | re.X,
)
PATH = re.compile(r"[a-z_.\-]+(?:/[a-z_.\-]+)+")
HASHED = re.compile(r"(?:\{?(?:sha-?\d+|md5|s?crypt|bcrypt|pbkdf2[\w-]*|argon2\w*)\}?[$:\-])|\$(?:2[aby]|argon2\w*|[156y]|pbkdf2[\w-]*)\$", re.I)
CAPITALS = re.compile(r"[A-Z]+(?:_[A-Z]+)*")


def strong(value: str, least: int = 6) -> bool:
    """Not a plain word, name or number: at least two kinds of characters."""
    if len(value) < least or not value.isprintable():
        return False
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() and c not in "_-.:/ ," for c in value)))
    if kinds < 2 or re.fullmatch(r"[A-Z]?[a-z]+|[\d.,:/\-+ eETZ%]+(?:ms|s|kb|mb|gb|k|m|h|d|px|%)?|0x[\da-f]{1,8}|v?\d+(?:\.\d+)+\w*", value, re.I if value.islower() else 0):
        return False
    return not re.fullmatch(r"[A-Za-z]?[a-z]*(?:[A-Z][a-z]+)+", value)  # a name in camel case


def literal(value: str, quoted: bool) -> bool:
    """Whether a value at a telling place is a credential itself."""
    v = value.strip()
    if PLACEHOLDER.fullmatch(v) or REFERENCE.match(v) or HASHED.match(v) or CAPITALS.fullmatch(v) or PATH.fullmatch(v) or "${" in v or "{{" in v:
        return False
    if not strong(v, 6 if quoted else 8) or (" " in v and not (quoted and len(v) >= 12 and any(c.isdigit() for c in v))):
        return False
    text = as_text(v)
    return text is None or not (PLACEHOLDER.fullmatch(text.strip()) or CAPITALS.fullmatch(text.strip()))


# --- layers ----------------------------------------------------------------------------------------------------------
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_\-=])(?:[A-Za-z0-9+/]{16,}|[A-Za-z0-9_\-]{16,})={0,2}(?![A-Za-z0-9+/_=])")
HEX = re.compile(r"(?<![\w+/])(?:0x)?((?:[0-9a-f]{2}){16,}|(?:[0-9A-F]{2}){16,})(?![\w+/=])")
PERCENT = re.compile(r"[\w.~!*'()+\-%]*(?:%[0-9A-Fa-f]{2}[\w.~!*'()+\-]*){3,}")
ESCAPES = re.compile(r"(?:[\w .:=;@/+\-]*(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4})){4,}[\w .:=;@/+\-]*")


def from_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True) if len(body) % 4 != 1 else None
    except (binascii.Error, ValueError):
        return None


def readable(data: bytes | None) -> str | None:
    """The bytes as text, if they are text of more than a few letters."""
    if not data or len(data) < 6:
        return None
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\r\n\t" for c in text) else None


def as_text(value: str) -> str | None:
    """What a base64 value holds, if that is text."""
    return readable(from_base64(value)) if len(value) >= 8 and re.fullmatch(r"[A-Za-z0-9+/_\-]+={0,2}", value) else None


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, begin, end of the content) of the DER element at ``at``, if it is whole."""
    if at + 2 > end:
        return None
    size, at2 = data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at2 + n > end:
            return None
        size, at2 = int.from_bytes(data[at2 : at2 + n], "big"), at2 + n
    return (data[at], at2, at2 + size) if at2 + size <= end else None


def private_container(data: bytes | None) -> str | None:
    """The kind of private key a container holds by its grammar; None for public keys, certificates and anything else."""
    if not data or len(data) < 40:
        return None
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh"
    outer = _der(data, 0, len(data)) if data[0] == 0x30 else None
    if outer is None or outer[2] < len(data) - 2:
        return None
    parts, at = [], outer[1]
    while at < outer[2] and len(parts) < 10:
        e = _der(data, at, outer[2])
        if e is None:
            return None
        parts.append(e)
        at = e[2]
    tags = [p[0] for p in parts]
    if len(parts) < 2:
        return None
    if tags[0] == 0x02:
        version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big")
        if version == 3 and tags[1] == 0x30 and data[parts[1][1] : parts[1][1] + 1] == b"\x06":
            return "pkcs12"
        if version in (0, 1) and len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return "pkcs1"
        if version in (0, 1) and tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04 and data[parts[1][1] : parts[1][1] + 1] == b"\x06":
            return "pkcs8"
        if version == 1 and tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:
            return "sec1"
    if tags == [0x30, 0x04] and data[parts[0][1] : parts[0][1] + 1] == b"\x06":
        oid = _der(data, parts[0][1], parts[0][2])
        if oid and data[oid[1] : oid[1] + 7] == b"\x2a\x86\x48\x86\xf7\x0d\x01":
            return "pkcs8-encrypted"
    return None


# --- finds -----------------------------------------------------------------------------------------------------------
@dataclass
class Find:
    """``start``: where the value begins; ``pieces``: (start, end, replacement) of what is redacted; ``layers`` of encoding."""

    start: int
    kind: str
    pieces: list[tuple[int, int, str]]
    layers: int = 0


PEM = re.compile(
    r"-----BEGIN (?P<label>[A-Z0-9 ]*?)-----(?P<body>(?:(?:\s|\\[nr])+(?:[A-Za-z][A-Za-z\-]+: [^\n\\]+|[A-Za-z0-9+/=]+)(?=\s|\\[nr]|-----|[\"'`<]|$))*)(?:(?:\s|\\[nr])*-----END [A-Z0-9 ]*-----)?"
)
PEM_LINE = re.compile(r"(?<![A-Za-z0-9+/=\\])[A-Za-z0-9+/=]{4,}|(?<=\\[nr])[A-Za-z0-9+/=]{4,}")
ADDRESS = re.compile(r"\b[A-Za-z][\w+.\-]*://[^\s/:@\"'`<>]*:(?P<v>[^\s@\"'`<>]+)@(?=[\w\[.])")
BEARER = re.compile(r"\b(?P<kind>bearer|basic)\s+(?P<v>[^\s\"'`<>,;]{6,})", re.I)
USER = re.compile(r"(?<![\w\-])(?:-u|--user)[ =][\"']?[^\s:\"'$]+:(?P<v>[^\s\"']+)")
PAIR = re.compile(r"\bauth\s*=\s*\(\s*([\"'])[^\"'\n]*\1\s*,\s*([\"'])(?P<v>(?:(?!\2)[^\\\n]|\\.)*)\2")
LOGIN = re.compile(r"\b(?:log ?in|sign ?in|connect|login|anmelden|anmeldung)\s+(?:as|with|als|mit)\s+\S+\s*/\s*(?P<v>\S+)", re.I)
JWT = re.compile(r"(?<![\w\-])(?P<v>eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,})")
TOKEN = re.compile(r"(?<![\w/+=.\-])(?P<v>(?P<p>[a-z][a-z0-9]{1,9}(?:[-_][a-z0-9]{2,6}){0,2})[-_.][A-Za-z0-9]{18,}|(?:AKIA|ASIA|AIza)[A-Za-z0-9_\-]{16,}|github_pat_\w{22,}|xox[abprs]-[\w\-]{16,})(?![\w/+=\-])")
LEFTOVER = re.compile(r"(?:#|//|--|;|<!--)[^\n]{0,80}?\b(?:still works|still valid|do not commit|old one|tmp|temp|temporary|fallback|prod|staging)\b[^\n:=]{0,40}[:=]\s*(?P<v>[^\s\"'`]{12,})", re.I)
OPEN_QUOTE = re.compile(r"[rRbBuU]{0,2}(\"\"\"|'''|[\"'`])")
VALUE_TWIN = re.compile(r"[\"']?\s*,?\s*[\"']?value[\"']?\s*[:=]\s*")
DEFAULT = re.compile(r"[\"']\s*,\s*(?=[rbu]?[\"'])")
FALLBACK = re.compile(r"[\w.\[\]()\"']{1,80}\s*(?:\|\||\?\?|\bor\b)\s*(?=[\"'`])")
OPERATOR = re.compile(r"[\"'`]?\]?[ \t]*(?::=|=>|[:=](?!=))[ \t]*")
TYPED = re.compile(r"[\w\[\]|., ]{1,40}=[ \t]*(?=[rbuf]?[\"'])")
BARE_END = re.compile(r"[\s;\"'`<]")
ELEMENT = re.compile(r"(?:\s[^<>\n]*)?>\s*(?P<v>[^<>]*?)\s*</")
SAYS = re.compile(r"[\"'`*]{0,3}(?:[ \t]+(?:is|are|was|lautet|ist|est|es|now|for [\w\-]+ is))?[ \t]*[:=]?[ \t]+[`\"']{0,2}(?P<v>[^\s`\"',;]{8,})", re.I)
FLAG_VALUE = re.compile(r"(?:=|[ ]+)(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)")


def _quoted(text: str, at: int) -> tuple[int, int, int, str] | None:
    """(begin, end of the content, end with the quote, quote) of the string literal at ``at``."""
    m = OPEN_QUOTE.match(text, at)
    if not m:
        return None
    q, i = m.group(1), m.end()
    while True:
        j = text.find(q, i)
        if j < 0 or (len(q) == 1 and q != "`" and 0 <= text.find("\n", m.end()) < j):
            return None
        back = j
        while text[back - 1] == "\\" and back > m.end():
            back -= 1
        if (j - back) % 2 == 0:
            return m.end(), j, j + len(q), q
        i = j + 1


def _literals(text: str, at: int, close: str) -> list[tuple[int, int]]:
    """Contents of the string literals from ``at`` on that stand together (with + or blanks, to ``close`` if given)."""
    out = []
    while (q := _quoted(text, at)) is not None:
        out.append((q[0], q[1]))
        at = q[2]
        m = re.compile(r"\s*,?\s*" if close == "]" else r"\s*\+?\s*" if close else r"[ \t]*(?:\+|\\\n|\.(?=\s))\s*|[ \t]+(?=[\"'])").match(text, at)
        if not m:
            break
        if close and text[m.end() : m.end() + 1] == close:
            return out if close != "]" or re.compile(r"\]\s*\.\s*join").match(text, m.end()) else []
        at = m.end()
    return out if not close else []


def _trimmed(text: str, a: int, z: int) -> tuple[int, int]:
    while a < z and text[a].isspace():
        a += 1
    while z > a and text[z - 1].isspace():
        z -= 1
    return a, z


def _value(text: str, at: int, indent: int) -> tuple[list[tuple[int, int]], bool]:
    """(pieces, quoted) of the value that stands at ``at`` behind an operator."""
    c = text[at : at + 1]
    if c in ("", "\n", "\r"):
        m = re.compile(r"\r?\n([ \t]*)").match(text, at)
        if not m or len(m.group(1)) <= indent:
            return [], False
        at = m.end()
        if _quoted(text, at):
            return _literals(text, at, ""), True
        line = text[at : (text + "\n").index("\n", at)].rstrip()
        return ([(at, at + len(line))], False) if line and not re.match(r"[#\-/<{\[]|[\w\-\"']+\s*[:=](?:\s|$)", line) else ([], False)
    if m := re.compile(r"[|>][+\-]?\d?[ \t]*\r?\n").match(text, at):
        pieces, p = [], m.end()
        while (line := re.compile(r"([ \t]*)([^\r\n]*)\r?(?:\n|$)").match(text, p)) and line.group(2) and len(line.group(1)) > indent:
            pieces.append((line.start(2), line.start(2) + len(line.group(2).rstrip())))
            p = line.end()
        return pieces, True
    if c in "([":
        m = re.compile(r"\s*").match(text, at + 1)
        return _literals(text, m.end(), ")" if c == "(" else "]"), True
    if _quoted(text, at):
        return [_trimmed(text, *p) for p in _literals(text, at, "")], True
    m = BARE_END.search(text, at)
    end = m.start() if m else len(text)
    while end > at and text[end - 1] in ",)}]":
        end -= 1
    return ([(at, end)] if end > at else []), False


def _by_name(text: str) -> Iterator[Find]:
    done = -1
    for m in KEYWORD.finditer(text):
        if m.start() < done:
            continue
        left = NAME_LEFT.search(text, max(0, m.start() - 80), m.start()).start()
        right = NAME_RIGHT.match(text, m.end()).end()
        name = text[left:right].rstrip(".-")
        right = done = max(left + len(name), m.end())
        if name.startswith("--"):
            flag = FLAG_VALUE.match(text, right)
            if flag and telling(name.strip("-")) and literal(flag["v"], True):
                yield Find(flag.start("v"), "flag", [(*flag.span("v"), MARK)])
            continue
        name = name.strip("-.")
        told = telling(name) or text[left:right].lower() == "mot de passe"
        if not told:
            continue
        before = text[max(0, left - 40) : left]
        pieces: list[tuple[int, int]] = []
        quoted, kind = True, "assignment"
        line_start = text.rfind("\n", 0, left) + 1
        indent = len(text[line_start:left]) - len(text[line_start:left].lstrip())
        if before.endswith("<") and (e := ELEMENT.match(text, right)):
            pieces, kind = [e.span("v")], "element"
        elif re.search(r"(?:name|key|id)[\"']?\s*[:=]\s*[\"']?\Z", before) and (e := VALUE_TWIN.match(text, right)):
            pieces, quoted = _value(text, e.end(), indent)
        elif re.search(r"(?:getenv|environ\.get|\benv|\.get|config|setting|pop)\(\s*[\"']\Z", before) and (e := DEFAULT.match(text, right)):
            pieces = _literals(text, e.end(), "")
        elif e := OPERATOR.match(text, right):
            at = e.end()
            if (t := TYPED.match(text, at)) and ":" in e.group():
                at = t.end()
            elif t := FALLBACK.match(text, at):
                at = t.end()
            pieces, quoted = _value(text, at, indent)
        elif (e := SAYS.match(text, right)) and literal(v := e["v"].rstrip(".,;:!?)"), False) and any(c.isdigit() or not c.isalnum() for c in v) and sum((any(c.isupper() for c in v), any(c.islower() for c in v), any(c.isdigit() for c in v))) >= 2:
            yield Find(e.start("v"), "prose", [(e.start("v"), e.start("v") + len(v), MARK)])
            continue
        if not pieces:
            continue
        value = "".join(text[a:z] for a, z in pieces)
        basic = re.match(r"(?:bearer|basic|token)\s+", value, re.I)
        if basic or not literal(value, quoted):
            continue
        inner = as_text(value) if len(pieces) == 1 else None
        mark = base64.b64encode(MARK.encode()).decode() if inner is not None else MARK
        yield Find(pieces[0][0], kind, [(a, z, "" if i else mark) for i, (a, z) in enumerate(pieces)], int(inner is not None))


def _by_form(text: str) -> Iterator[Find]:
    if "://" in text:
        for m in ADDRESS.finditer(text):
            v = m["v"]
            if not (PLACEHOLDER.fullmatch(v) or REFERENCE.match(v) or CAPITALS.fullmatch(v) or "{" in v or v.isdigit()):
                yield Find(m.start("v"), "address", [(*m.span("v"), MARK)])
    for m in BEARER.finditer(text):
        v = m["v"].rstrip(").]}")
        inner = as_text(v) if m["kind"].lower() == "basic" else None
        if m["kind"].lower() == "basic":
            if inner is None or ":" not in inner or PLACEHOLDER.fullmatch(inner.partition(":")[2].strip()) or CAPITALS.fullmatch(inner.partition(":")[2]):
                continue
            yield Find(m.start("v"), "header", [(m.start("v"), m.start("v") + len(v), base64.b64encode(f"{inner.partition(':')[0]}:{MARK}".encode()).decode())], 1)
        elif literal(v, False) and (any(c.isdigit() for c in v) or not v.replace("-", "").isalpha()):
            yield Find(m.start("v"), "header", [(m.start("v"), m.start("v") + len(v), MARK)])
    for rx, kind in ((USER, "flag"), (PAIR, "pair"), (LOGIN, "prose")):
        for m in rx.finditer(text):
            v = m["v"].rstrip(".,;") if kind == "prose" else m["v"]
            if literal(v, True):
                yield Find(m.start("v"), kind, [(m.start("v"), m.start("v") + len(v), MARK)])
    if "eyJ" in text:
        for m in JWT.finditer(text):
            head = readable(from_base64(m["v"].split(".")[0]))
            if head and '"alg"' in head:
                yield Find(m.start("v"), "jwt", [(*m.span("v"), MARK)])
    for m in TOKEN.finditer(text):
        v = m["v"]
        tail = v[len(m["p"] or "") :]
        if not re.match(r"sha\d|md5|blake|uuid|urn|data|rev", v) and any(c.isupper() for c in tail) and any(c.islower() or not m["p"] for c in tail) and any(c.isdigit() for c in tail):
            yield Find(m.start("v"), "token", [(*m.span("v"), MARK)])
    for m in LEFTOVER.finditer(text):
        if literal(m["v"], False) and any(c.isdigit() for c in m["v"]) and not re.fullmatch(r"[0-9a-f]{32,}|[0-9a-f\-]{36}|\S*://\S*", m["v"]):
            yield Find(m.start("v"), "leftover", [(*m.span("v"), MARK)])


def _blocks(text: str) -> tuple[list[Find], list[tuple[int, int]]]:
    """Private key blocks, and the spans of all blocks (what else is in them isn't read)."""
    finds, spans = [], []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            spans.append(m.span())
            body = m["body"]
            lines = [p for p in PEM_LINE.finditer(body) if p.group() != MARK and not re.match(r"[A-Za-z\-]+:", body[p.start() :])]
            if "PRIVATE KEY" in m["label"] and sum(len(p.group()) for p in lines) >= 24:
                o = m.start("body")
                finds.append(Find(m.start(), "key block", [(o + p.start(), o + p.end(), MARK) for p in lines]))
    return finds, spans


def _layers(text: str, taken: list[tuple[int, int]]) -> Iterator[Find]:
    """Finds inside encoded literals; they count where the literal begins."""

    def free(a: int, z: int) -> bool:
        return not any(a < y and x < z for x, y in taken)

    def inside(a: int, z: int, plain: str | None, again, kind: str) -> Iterator[Find]:
        if plain is None or len(plain) >= z - a or not free(a, z):
            return
        found = scan(plain)
        if found:
            yield Find(a, f"{kind} of {found[0].kind}", [(a, z, again(redact(plain, found)))], 1 + max(f.layers for f in found))

    for m in BASE64.finditer(text):
        body = m.group()
        if "/" not in body and "+" not in body and (body.isalpha() and (body.islower() or body.isupper()) or "_" in body and not any(c.isupper() for c in body)):
            continue
        data = from_base64(body)
        if data is None:
            continue
        if (kind := private_container(data)) and free(*m.span()):
            yield Find(m.start(), kind, [(*m.span(), base64.b64encode(MARK.encode()).decode())], 1)
        else:
            yield from inside(*m.span(), readable(data), lambda s: base64.b64encode(s.encode()).decode(), "base64")
    for m in HEX.finditer(text):
        data = bytes.fromhex(m.group(1))
        if (kind := private_container(data)) and free(*m.span()):
            yield Find(m.start(1), kind, [(*m.span(1), MARK.encode().hex())], 1)
        else:
            yield from inside(*m.span(1), readable(data), lambda s: s.encode().hex(), "hex")
    if "%" in text:
        for m in PERCENT.finditer(text):
            yield from inside(*m.span(), readable(urllib.parse.unquote_to_bytes(m.group())), lambda s: urllib.parse.quote(s, safe=""), "percent")
    if "\\x" in text or "\\u" in text:
        for m in ESCAPES.finditer(text):
            plain = re.sub(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})", lambda e: chr(int(e[1] or e[2], 16)), m.group())
            yield from inside(*m.span(), plain if plain.isprintable() else None, lambda s: "".join(f"\\x{ord(c):02x}" if ord(c) < 256 else f"\\u{ord(c):04x}" for c in s), "escapes")


def scan(text: str) -> list[Find]:
    """All finds of a text in order; none overlaps another."""
    blocks, spans = _blocks(text)
    finds = blocks
    taken = list(spans)
    for f in sorted((*_by_name(text), *_by_form(text)), key=lambda f: (f.start, -f.pieces[-1][1])):
        a, z = f.pieces[0][0], f.pieces[-1][1]
        if not any(a < y and x < z for x, y in taken):
            finds.append(f)
            taken.append((a, z))
    finds += _layers(text, taken)
    return sorted(finds, key=lambda f: f.start)


def redact(text: str, finds: list[Find]) -> str:
    """The text with every find replaced; all else stays as it is."""
    out, at = [], 0
    for a, z, by in sorted(p for f in finds for p in f.pieces):
        if a >= at:
            out += [text[at:a], by]
            at = z
    return "".join(out) + text[at:]


def find_credentials(df: DataFrame, key: str, text: str) -> DataFrame:
    """row_key, line_no, kind, layers, start_char, end_char: one row for each find.

    Lines count from 1 and end with "\\n"; a find counts on the line where its value (or the literal that encodes it)
    begins. Null and empty texts have none, rows without a key give no rows, repeated rows give repeated finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, cols = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for f in scan(t):
                    at.append(i)
                    cols.append((t.count("\n", 0, f.start) + 1, f.kind, f.layers, f.start, f.pieces[-1][1]))
            line, kind, layers, a, z = zip(*cols) if cols else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(line, pa.int64()), pa.array(kind, pa.string()), pa.array(layers, pa.int64()), pa.array(a, pa.int64()), pa.array(z, pa.int64())],
                ["row_key", "line_no", "kind", "layers", "start_char", "end_char"],
            )

    rows = df.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where(F.col("k").isNotNull() & (F.length("t") > 0))
    return rows.mapInArrow(run, "row_key string, line_no long, kind string, layers long, start_char long, end_char long")


def redacted(df: DataFrame, key: str, text: str) -> DataFrame:
    """row_key, n_found, text of every row: the text with its credentials replaced. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, out = [], []
            for t in b.column(1).to_pylist():
                found = scan(t) if t else []
                count.append(len(found))
                out.append(redact(t, found) if found else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count, pa.int64()), pa.array(out, pa.string())], ["row_key", "n_found", "text"])

    rows = df.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(run, "row_key string, n_found long, text string")
