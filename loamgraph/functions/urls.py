"""URL canonicalisation and the scalar rules of crawling.

The exact forms are vectorised Python (one call per Arrow batch); the
``*_sql`` functions are the parts that built-in expressions cover and stay in
generated code.
"""

from __future__ import annotations

import hashlib
import ipaddress
from collections import Counter
from urllib.parse import urljoin, urlsplit

import pandas as pd
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that results depend on.
MAX_URL = 2048
TRACKING = ("gclid", "fbclid", "msclkid", "dclid", "yclid", "mc_cid", "mc_eid", "_ga", "_gl", "igshid", "ref_src", "sessionid", "sid", "jsessionid", "phpsessid", "aspsessionid", "cfid", "cftoken")
LEARN_VALUES = 3
MAX_SEGMENTS, MAX_REPEATS, MAX_PARAMS, MAX_VARIANTS = 20, 3, 10, 50
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "ac", "edu")
EXTENSIONS = {
    "IMAGE": "jpg jpeg png gif webp svg ico avif bmp",
    "VIDEO": "mp4 webm mov m3u8 mpd avi mkv",
    "AUDIO": "mp3 wav ogg m4a flac aac",
    "CSS": "css",
    "SCRIPT": "js mjs",
    "FONT": "woff woff2 ttf otf eot",
    "DOCUMENT": "pdf doc docx xls xlsx ppt pptx",
    "OTHER": "zip gz tar exe dmg bin",
}
# Media types by pattern, first match counts.
MEDIA = [("PAGE", r"^(text/html|application/xhtml)"), ("IMAGE", r"^image/"), ("VIDEO", r"^video/|mpegurl|dash\+xml"), ("AUDIO", r"^audio/"), ("CSS", r"^text/css"), ("SCRIPT", r"javascript|ecmascript"), ("FONT", r"^font/|font-woff"), ("DOCUMENT", r"^application/pdf|msword|officedocument")]

_UNSAFE = re.compile(r"[^\x21-\x7e]|[<>\"{}|\\^`]")
_ESCAPED = re.compile(r"%([0-9A-Fa-f]{2})")
_PLAIN = re.compile(r"[A-Za-z0-9._~-]")
_HOST = re.compile(r"[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\.?|\[[0-9a-f:.]+\]")


def _percent(text: str) -> str:
    """Escapes in capitals, those of unreserved characters undone."""

    def one(m: re.Match) -> str:
        c = chr(int(m[1], 16))
        return c if _PLAIN.fullmatch(c) else m[0].upper()

    return _ESCAPED.sub(one, text)


def _ascii_host(host: str) -> str | None:
    host = host.lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode("ascii")
        except UnicodeError:
            return None
    return host.removesuffix(".") if _HOST.fullmatch(host) else None


def _dot_free(path: str) -> str:
    """Dot segments removed; parents above the root are dropped, empty segments stay."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "." or p == "..":
            if p == ".." and out:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(p)
    return "/" + "/".join(out)


def drops_param(name: str, learned: frozenset | set = frozenset()) -> bool:
    low = name.lower()
    return low.startswith("utm_") or low in TRACKING or low in learned


def canonical(raw: str | None, base: str | None = None, learned: dict[str, set] | None = None) -> str | None:
    """The canonical form of a reference, or None where it names no http(s) page.

    ``learned``: host -> parameters found irrelevant there.
    """
    if raw is None or not raw.strip():
        return None
    text = _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), raw.strip()) if not raw.isascii() or _UNSAFE.search(raw.strip()) else raw.strip()
    # an international host must reach IDNA unescaped
    m = re.match(r"(?i)(https?:)?//([^/?#]*)", raw.strip())
    if m and not m[2].isascii():
        text = (m[1] or "") + "//" + m[2] + _UNSAFE.sub(lambda x: "".join(f"%{b:02X}" for b in x[0].encode("utf-8", "surrogatepass")), raw.strip()[m.end() :])
    try:
        if base is not None:
            text = urljoin(base if urlsplit(base).path else base + "/", text)
        parts = urlsplit(text)
        port = parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in ("http", "https") or not parts.hostname:
        return None
    shown = parts.netloc.rpartition("@")[2]
    host = _ascii_host(shown.rpartition(":")[0] if port is not None or shown.endswith(":") else shown)
    if not host:
        return None
    if port == {"http": 80, "https": 443}[scheme]:
        port = None
    path = _percent(_dot_free(parts.path or "/"))
    known = (learned or {}).get(host, frozenset())
    pairs = [_percent(p) for p in parts.query.split("&") if p and not drops_param(p.partition("=")[0], known)]
    query = "&".join(sorted(pairs, key=lambda p: (p.partition("=")[0], p)))
    out = f"{scheme}://{host}{'' if port is None else f':{port}'}{path}{'?' + query if query else ''}"
    return out if len(out) <= MAX_URL else None


def canonicals(raw: Column, base: Column | None = None) -> Column:
    @F.pandas_udf("string")
    def alone(s: pd.Series) -> pd.Series:
        return s.map(canonical, na_action="ignore").astype(object)

    @F.pandas_udf("string")
    def joined(s: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([canonical(x, y) if isinstance(x, str) else None for x, y in zip(s, b.where(b.notna(), None), strict=True)], dtype=object)

    return alone(raw) if base is None else joined(raw, base)


def clean_query_sql(query: Column) -> Column:
    """A query without tracking parameters, sorted by name then text."""
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(*TRACKING))
    keyed = F.array_sort(F.transform(kept, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), p.alias("p"))))
    return F.array_join(F.transform(keyed, lambda x: x["p"]), "&")


def without_param_sql(url: Column, param: str) -> Column:
    """The URL with one query parameter taken out."""
    query = F.substring_index(url, "?", -1)
    kept = F.filter(F.split(query, "&"), lambda p: F.lower(F.substring_index(p, "=", 1)) != param.lower())
    base = F.substring_index(url, "?", 1)
    return F.when(F.locate("?", url) == 0, F.lit(None)).otherwise(F.when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(kept, "&"))))


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 32)


def url_hash_of(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()[:32]


def trap_sql(url: Column) -> Column:
    """Why a canonical URL looks like a trap, or null; the reasons' texts are fixed values."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?]*([^?]*)", 1)
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    named = F.filter(parts, lambda x: x != "")
    # the segment that is first met once too often
    over = F.filter(named, lambda x, i: F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda y: y == x)) > MAX_REPEATS)
    params = F.when(F.locate("?", url) > 0, F.size(F.split(F.substring_index(url, "?", -1), "&"))).otherwise(0)
    repeated = F.concat(F.lit("repeating path segment '"), F.get(over, F.lit(0)), F.lit("'"))
    return F.when(F.size(parts) > MAX_SEGMENTS, "path too deep").when(F.size(over) > 0, repeated).when(params > MAX_PARAMS, "too many query parameters")


def variant_key_sql(url: Column) -> Column:
    """Host and path of a URL with a query, under which its variants are counted."""
    return F.when(F.locate("?", url) > 0, F.regexp_extract(url, r"^[a-z]+://([^?]*)", 1))


def registrable_domain_sql(host: Column) -> Column:
    """Two labels, three below suffixes like co.uk; addresses stay whole."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    short = (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.greatest(-n, F.lit(-2))).isin(*SECOND_LEVEL)
    keep = F.when(short, 3).otherwise(2)
    tail = F.slice(labels, F.greatest(F.lit(1), n - keep + 1), keep)
    return F.when(host.contains(":") | host.rlike(r"^[0-9.]+$") | (n <= 2), host).otherwise(F.array_join(tail, "."))


def type_by_path_sql(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = None
    for kind, names in EXTENSIONS.items():
        cond = ext.isin(*names.split())
        out = F.when(cond, kind) if out is None else out.when(cond, kind)
    return out.otherwise("PAGE")


def type_by_media_sql(content_type: Column) -> Column:
    low = F.lower(content_type)
    out = F.when(content_type.isNull() | (F.trim(content_type) == ""), "OTHER")
    for kind, pattern in MEDIA:
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise("OTHER")


def type_by_path(path: str) -> str:
    m = re.search(r"\.([^./]*)$", path.lower())
    return next((k for k, names in EXTENSIONS.items() if m and m[1] in names.split()), "PAGE")


# --- egress ---------------------------------------------------------------

# Address ranges that are not public (fixed values: RFC 6890 and relatives).
_CLOSED = [ipaddress.ip_network(x) for x in "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.168.0.0/16 198.18.0.0/15 224.0.0.0/4 240.0.0.0/4 ::/128 ::1/128 fc00::/7 fe80::/10 fec0::/10 ff00::/8".split()]
_NAT64 = ipaddress.ip_network("64:ff9b::/96")


def is_public(address: str) -> bool | None:
    """Whether an address literal may be contacted; None where it is no address."""
    try:
        ip = ipaddress.ip_address(address.strip("[]"))
    except ValueError:
        return None
    if ip.version == 6:
        if ip.ipv4_mapped:
            ip = ip.ipv4_mapped
        elif ip in _NAT64:
            ip = ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)
    return not any(ip.version == n.version and ip in n for n in _CLOSED)


def public_addresses(address: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(is_public, na_action="ignore").astype(object)

    return run(address)


# --- robots ---------------------------------------------------------------


class Robots:
    """Rules of one robots file for one agent: (pattern, allow), delay in ms, sitemaps."""

    def __init__(self, text: str, agent: str):
        agent = agent.lower()
        own: dict[bool, list] = {True: [], False: []}  # by whether the group names the agent
        delay: dict[bool, int | None] = {True: None, False: None}
        self.sitemaps: list[str] = []
        groups: set[bool] = set()
        open_head = False
        for line in text.splitlines():
            key, colon, value = line.split("#", 1)[0].partition(":")
            key, value = key.strip().lower(), value.strip()
            if not colon:
                continue
            if key == "user-agent":
                if not open_head:
                    groups = set()
                name = value.lower()
                if name == "*":
                    groups.add(False)
                elif name in agent:
                    groups.add(True)
                open_head = True
                continue
            open_head = False
            if key in ("allow", "disallow") and value:
                for g in groups:
                    own[g].append((value, key == "allow"))
            elif key == "crawl-delay":
                try:
                    ms = int(float(value) * 1000)
                except ValueError:
                    continue
                for g in groups:
                    delay[g] = ms
            elif key == "sitemap":
                self.sitemaps.append(value)
        named = bool(own[True]) or delay[True] is not None
        self.rules, self.delay_ms = own[named], delay[named]

    def allows(self, path: str) -> bool:
        """Longest matching pattern decides, allow at equal length; nothing matching allows."""
        hits = [(len(p), ok) for p, ok in self.rules if robots_pattern(p).match(path)]
        return max(hits)[1] if hits else True


def robots_pattern(pattern: str) -> re.Pattern:
    body = pattern.removesuffix("$")
    return re.compile(".*".join(map(re.escape, body.split("*"))) + (r"\Z" if pattern.endswith("$") else ""), re.S)


def robots_policy_sql(status: Column) -> Column:
    """What a robots answer means: its rules for a day, all allowed, or nothing for ten minutes."""
    return F.when(status.between(200, 299), "RULES").when(status.between(400, 499), "ALLOW_ALL").otherwise("DISALLOW_ALL")


# --- Bloom filter ---------------------------------------------------------


class Bloom:
    """Membership without false negatives; sized for n keys at rate p."""

    def __init__(self, n: int, p: float):
        import math

        import numpy as np

        self.m = max(64, math.ceil(-n * math.log(p) / math.log(2) ** 2))
        self.k = max(1, round(self.m / max(1, n) * math.log(2)))
        self.bits = np.zeros((self.m + 7) // 8, np.uint8)

    def _places(self, keys):
        import numpy as np
        import xxhash

        a = np.array([xxhash.xxh64_intdigest(x, 0) for x in keys], np.uint64)
        b = np.array([xxhash.xxh64_intdigest(x, 1) for x in keys], np.uint64) | np.uint64(1)
        return (a[:, None] + b[:, None] * np.arange(self.k, dtype=np.uint64)) % np.uint64(self.m)

    def add(self, keys) -> None:
        import numpy as np

        if len(keys):
            at = self._places(keys).ravel()
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    def has(self, keys):
        import numpy as np

        at = self._places(keys)
        return ((self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1) if len(keys) else np.zeros(0, bool)


BLOOM_KEYS = 500_000


def bloom_filter(keys: DataFrame, p: float, per_part: int = BLOOM_KEYS) -> DataFrame:
    """``(part, parts, n, bits)``: a filter over all distinct keys, in parts of about ``per_part`` keys that no one holds together.

    ``keys(key string)``; nulls are no keys.  A key's part is a hash of it, so
    parts are even, and each has the bits its own number of keys asks for.
    """
    distinct = keys.where("key is not null").select("key").distinct()
    parts = max(1, -(-distinct.count() // per_part))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Bloom(len(pdf), p)
        f.add(pdf["key"].tolist())
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "parts": [parts], "n": [len(pdf)], "bits": [f.bits.tobytes()]})

    return distinct.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).groupBy("part").applyInPandas(build, "part int, parts int, n long, bits binary")


def bloom_known(keys: DataFrame, stored: DataFrame, p: float) -> DataFrame:
    """``(key, known)`` of the distinct keys; ``stored`` is a written ``bloom_filter`` of rate ``p``.  Keys meet their part, the filter is not broadcast."""
    import numpy as np

    parts = (stored.agg(F.max("parts")).first() or [None])[0] or 1
    asked = keys.where("key is not null").select("key").distinct().withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = np.zeros(len(left), bool)
        if len(left) and len(right):
            f = Bloom(int(right["n"].iloc[0]), p)
            f.bits = np.frombuffer(right["bits"].iloc[0], np.uint8)
            known = f.has(left["key"].tolist())
        return pd.DataFrame({"key": left["key"], "known": known})

    return asked.groupBy("part").cogroup(stored.groupBy("part")).applyInPandas(probe, "key string, known boolean")


def segment_counts(path: str) -> Counter:
    return Counter(x for x in path.split("/") if x)
