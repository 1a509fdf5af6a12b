"""Personal information inside free text (problem 9).

A semi-Markov conditional random field over candidate segments.  Generous
patterns propose whole spans with a type; each span is scored as a whole
(its own shape, word classes inside it and around it), text outside spans
scores 0, and a dynamic program over span boundaries picks the jointly best
set of spans and types.  Entities are bounded (``MAX_SPAN`` characters), so the
program is linear in the text.

Words enter the features only as members of small classes of general knowledge
(given names, colours and animals, cue words such as "phone" or "invoice",
function words, single tokens of a public tokenizer's vocabulary) or by their
form, never as themselves, so the model can't lean on the wording it was fitted
to.  Weights are fitted by conditional maximum
likelihood (forward-backward over the same lattice) on ``TRAIN_SENTENCES``
generated labelled sentences (see ``pii_sample``).  Neither a sentence nor a
word list is taken from the corpus; a test compares their five-word runs.

Defined results: null and empty texts hold nothing and stay as they are;
equal pieces of one document count once; texts of any length are read whole;
no personal piece longer than ``MAX_SPAN`` characters is proposed, except an
email address, which is taken at any length.
"""

from __future__ import annotations

import base64
import math
import random
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgraph.session import spread

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
MAX_SPAN = 160
MIN_DIGITS, MAX_DIGITS = 7, 15  # of a telephone number, country code included
TRAIN_SENTENCES = 12_000  # bound of the labelled sample
EPOCHS = 4
#: Vocabularies whose single tokens serve as a lexicon; read on the driver only and sent along with the weights.
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")

# Word classes: general knowledge, stated as plain text.
GIVEN = set(
    """james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles
    karen christopher lisa daniel nancy matthew anthony sandra mark margaret steven paul kimberly andrew emily joshua kenneth michelle kevin carol
    brian amanda george melissa timothy deborah oliver amelia noah arthur oscar harry sophie jack emma henry alice grace samuel ruth helen simon
    hans peter klaus wolfgang ursula monika petra sabine andrea stefan markus lukas leon finn jonas felix anna lena hannah mia heike martin julia
    maria jose antonio manuel francisco carmen ana isabel juan laura javier marta pablo lucia sofia diego carlos miguel pedro luis rosa elena
    jean pierre michel philippe alain nicolas marie nathalie isabelle camille chloe louis claire antoine giuseppe giovanni marco luca francesca
    giulia alessandro chiara paolo lars erik anders johan nils karin ingrid astrid magnus sven ivan olga natalia dmitri katarzyna piotr pavel
    tomas nina vera mohamed ahmed ali fatima omar hassan aisha yusuf ibrahim leila mehmet ayse priya raj amit anita kofi kwame amara wei yuki
    hiroshi kenji mei linh thu joao ines rui eva adam nora clara max ida emil hugo otto frida""".split()
)
ORDINARY = set(
    """red orange yellow green blue purple violet pink brown black white grey gray gold golden silver bronze copper scarlet crimson teal amber
    ivory indigo fox wolf bear otter badger beaver eagle hawk falcon owl raven crow heron swan crane sparrow tiger lion leopard panther lynx deer
    elk moose horse dolphin whale shark seal salmon trout turtle frog spider beetle bee oak pine cedar birch maple willow elm fern moss tulip
    clover thistle olive apple cherry lemon stone rock granite marble quartz flint slate sand clay coral pearl diamond ruby sapphire emerald jade
    opal topaz iron steel rain snow frost ice storm thunder cloud fog mist wind breeze sun moon star comet dawn dusk river lake ocean sea bay
    coast harbor harbour beach island hill mountain valley canyon meadow field forest desert prairie bridge castle tower garden gate mill road
    quiet silent swift quick rapid bright dark light heavy little big small great grand high low deep wide wild brave bold calm cool warm cold hot
    fast slow early late new old north south east west lucky noble royal solar lunar plain hollow hidden spring summer autumn winter morning night
    compass anchor lantern arrow rocket signal orbit horizon summit trail""".split()
)
TECHNICAL = set(
    """index search query cache queue server service client node cluster shard batch job task worker log error errors request response release
    version report review audit page site map menu table list tree graph tag label folder file record entry data model schema import export backup
    restore sync build deploy test draft preview public private internal beta feature flag mode bulk live smart auto open user guide admin settings
    dashboard help support sales finance legal marketing platform core main next known notes code status update gateway timeout internal found not
    bad moved redirect unavailable planner builder runner reader writer store storage engine tool tools design system network team group archive
    history access control quota limit limits rate policy editor view quick start street screen grid board header footer content type""".split()
)
CALENDAR = set("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday januar februar mai juni juli oktober dezember montag dienstag mittwoch donnerstag freitag enero febrero marzo abril junio lunes martes jueves viernes".split())
FUNCTION = set(
    """a about after all also am an and another any are as at be because been before between both but by can could did do does each either few for
    from get had has have he her here his how i if in into is it its just many me might more most must my near neither never no nor not now of
    off often on once one only or other our out over please see shall she should since so some still such than that the their them then there
    these they this those though through to too under until up us use very was we were what when where whether which while who whose why with
    would yes yet you your der die das den dem des ein eine einen einem einer und oder aber nicht kein auf aus bei bis für gegen im ist ins mit nach
    ohne sich sie sind um unter von vom vor wenn wer wie wir zu zum zur el los las un una unos y o pero con sin por para sobre hasta desde lo que
    se su es son al falls ob dass damit sobald bevor nachdem während jede jeder jedes keine keiner unser unsere ihr ihre mein dein sein bitte ja nein auch
    nur noch schon dann hier dort""".split()
)
STREET_END = set("street st road rd lane ln avenue ave drive dr boulevard blvd court ct place pl square sq terrace way close crescent row walk grove gardens parkway highway alley".split())
STREET_START = set("calle avenida avda plaza paseo camino carrera rue via viale piazza corso place chemin".split())
STREET_FUSED = re.compile(r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|steig)$", re.I)
GERMAN_NOUN = re.compile(r"(?:ung|ungen|heit|keit|schaft|tion|tät|nis|tum|en|er|el|ler|gang|zeit|satz)s?$")
SURNAME = re.compile(r"(?:son|sen|berg|burg|mann|stein|feld|ez|ini|elli|ova|sky|ski|ley|ton|ford|ham|well|wood|wick|quist|vik|oğlu|poulos|escu|enko|yan|ard|ier|eau|ault|dottir)$")
#: Cue words and the class that each stands for.
CUES = {
    w: cue
    for cue, names in {
        "<phone>": "phone telephone tel call calls called calling ring rings dial dials mobile cell fax telefon telefono teléfono móvil handy anruf anrufen llamar llame reach reached reachable hotline whatsapp erreichbar number",
        "<id>": "ssn social security insurance ni nino passport passports identity identification id-card national personal citizen dni nif nie ausweis reisepass personalausweis pasaporte identidad documento sozialversicherung steuer tax-id licence travel",
        "<thing>": "order orders invoice ticket serial part item case job batch build version account card tracking model product article code key reference ref sku isbn checksum hash id ids row rows page pages node port error bucket range size bytes timestamp lot parcel shipment contract bestellung rechnung pedido factura numbered numbers",
        "<person>": "mr mrs ms miss dr prof herr frau señor señora sr sra monsieur madame dear hello hi signed sincerely regards faithfully cheers author owner sender speaker contact assignee attn attention reported written approved requested thanks met colleague manager",
        "<place>": "address lives live living moved moves office located visit visits street deliver delivered delivery ship ships wohnt wohnhaft anschrift adresse vive domicilio dirección house flat post mail",
        "<group>": "team teams squad group groups crew department committee gruppe abteilung equipo equipos grupo guild tribe unit",
        "<title>": "title titles heading headings chapter chapters section sections named called slide film book song headline",
        "<mail>": "email e-mail mail mails cc bcc to write writes correo",
    }.items()
    for w in names.split()
}

_CAP = r"(?:[dDlL]['’]\p{Lu}[\p{L}'’]*|O['’]\p{Lu}[\p{L}'’]*|\p{Lu}[\p{L}'’]+)(?:-\p{Lu}[\p{L}'’]+)*"
_PART = r"(?:von|van|de|del|du|des|della|da|di|der|den|dos|la|le|bin|al)"
_AT = r"(?:[  ]?[@＠][  ]?|[  ]*[\[({<][  ]*(?:at|AT|At|ät|@|arroba)[  ]*[\])}>][  ]*|&#0*64;|&#x0*40;|&commat;|%40| at | AT )"
_DOT = r"(?:[.．]|[  ]*[\[({<][  ]*(?:dot|DOT|Dot|punkt|punto|\.)[  ]*[\])}>][  ]*| dot | DOT )"
EMAIL = re.compile(rf"(?<![\p{{L}}\p{{N}}.+_%-])[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}._%+'’-]*(?<![.'’-]){_AT}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*(?:{_DOT}[\p{{L}}\p{{N}}-]+)+")
NUMBER = re.compile(r"(?<![\p{L}\p{N}_])(?<![\p{L}\p{N}][-.:/=,])(?:\+|\(\+?)?\d(?:\d|[   ().\-‐‑‒–/]{1,3}(?=[\d(]))*\d(?![\p{L}\p{N}_])")
GROUPS = re.compile(r"[+(]*\d+\)?")
ID = re.compile(r"(?<![\p{L}\p{N}_-])(?:\p{Lu}{1,2}[  ]?(?:\d{2}[  ]?){3}\p{Lu}|\p{Lu}{1,3}[  ]?\d{6,9}\p{Lu}?\d?|\d{6}[-+A]\d{3}[\p{Lu}\d]|\d{3}([  .\-‑])\d{2}\1\d{4}|\d{8}-?\p{Lu}|[XYZ]-?\d{7}-?\p{Lu}|\d{10,12}|\d{6}-\d{4}|\p{Lu}{6}\d{2}\p{Lu}\d{2}\p{Lu}\d{3}\p{Lu}|\p{Lu}\d{2}\p{Lu}{2,3}\d{4,5})(?![\p{L}\p{N}_])(?!-\d)")
BARE_ID = re.compile(r"(?<=^\p{Lu}{2,3}[  ])\d{6,9}\p{Lu}?$")
HOUSE_FIRST = re.compile(rf"(?<![\p{{L}}\p{{N}}_.,:/=-])\d{{1,5}}[a-zA-Z]?,?[  ](?:(?:{_CAP}|\p{{Lu}}\.|{_PART}|rue|St\.|\d{{1,3}}(?:st|nd|rd|th))[  ])*{_CAP}(?![\p{{L}}\p{{N}}_])")
#: A house number behind the name of a street, and, read backwards from it, the words before.
HOUSE_TAIL = re.compile(r"(?<=\p{L}\.?,?[ \u00a0])\d{1,4}(?:[ \u00a0]?[a-zA-Z])?(?![\p{L}\p{N}_/:.,-]*[\p{L}\p{N}])")
HOUSE_WORDS = re.compile(rf"(?<![\p{{L}}\p{{N}}_])(?:(?:{_CAP}|\p{{Lu}}\.|{_PART}|rue|calle)[ \u00a0]|{_CAP},[ \u00a0])*(?:{_CAP}|{_CAP}\.),?[ \u00a0]", re.REVERSE)
RUN = re.compile(rf"(?<![\p{{L}}\p{{N}}_.@/=&;-])(?:{_CAP}|\p{{Lu}}\.)(?:,?[  ](?:{_CAP}|\p{{Lu}}\.(?!\p{{L}})|{_PART}(?=[  ](?:{_PART}[  ])*\p{{Lu}})))+(?![\p{{L}}\p{{N}}_@=/-]|\.\p{{L}})")
TOKEN = re.compile(r"[^  ]+")
#: What stands between user and the second label of the host: whatever ``EMAIL`` matches holds it.
AT_HOST = re.compile(rf"{_AT}[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}-]*{_DOT}[\p{{L}}\p{{N}}-]")
CUT_AFTER, CUT_BEFORE = re.compile(r"[  .\-‑]\(?\d"), re.compile(r"\d[  .\-‑]?$")
IPV4, DATE = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}"), re.compile(r"(?:19|20)\d\d[-/.]\d\d[-/.]\d\d")
ZEROS, SEPARATORS = re.compile(r"0+"), re.compile(r"[0A]")
AT, DOT = re.compile(_AT), re.compile(_DOT)
CAPITAL_NEXT, CAPITAL_BEFORE = re.compile(r"[  ]\p{Lu}"), re.compile(r"(\p{Lu}[\p{L}'’-]*,?)[  ]$")
WORD = re.compile(r"\p{L}[\p{L}'’.-]*\p{L}|\p{L}|\d+|[^\s\p{L}\p{N}]|\n")


def _windows(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Spans of at least two tokens of one run within ``MAX_SPAN``; a comma at a span's end stays outside."""
    toks = [(start + m.start(), start + m.end()) for m in TOKEN.finditer(text[start:end])]
    for i, (s, _) in enumerate(toks):
        for _, b in toks[i + 1 :]:
            e = b - (text[b - 1] == ",")
            if e - s > MAX_SPAN:
                break
            yield s, e


def _house_at_end(piece: str) -> bool:
    last = piece.split()[-2:]
    return not piece[0].isdigit() and any(c.isdigit() for c in piece[-3:]) and any(c.isdigit() for w in last for c in w)


def _may_begin(word: str) -> bool:
    """A name starts with a capital and with no article, pronoun or other function word."""
    return not word.islower() and word.lower() not in FUNCTION


def candidates(text: str) -> list[tuple[int, int, str]]:
    """All proposed (start, end, kind)."""
    out = set()
    if AT_HOST.search(text):
        out.update((*m.span(), "email") for m in EMAIL.finditer(text))
    for m in NUMBER.finditer(text):
        s, e = m.span()
        if e - s < MIN_DIGITS:
            continue
        groups = [(s + g.start(), s + g.end(), len(g[0].strip("+()"))) for g in GROUPS.finditer(text[s:e])]
        for i, (a, _, _) in enumerate(groups):
            digits = 0
            for _, b, n in groups[i:]:
                digits += n
                if digits > MAX_DIGITS or b - a > MAX_SPAN:
                    break
                if digits >= MIN_DIGITS:
                    end = b - (text[b - 1] == ")")
                    # a bracket that closes behind the number belongs to the sentence
                    out.add((a + (text[a] == "(" and ")" not in text[a:end]), end, "phone"))
    for m in ID.finditer(text):
        out.add((*m.span(), "id_number"))
        if bare := BARE_ID.search(m[0]):  # a label in capitals before the number
            out.add((m.start() + bare.start(), m.end(), "id_number"))
    for m in HOUSE_FIRST.finditer(text):
        out.update((s, e, "address") for s, e in _windows(text, *m.span()) if text[s].isdigit())
    for m in HOUSE_TAIL.finditer(text):
        if head := HOUSE_WORDS.match(text, max(0, m.end() - 2 * MAX_SPAN), m.start()):
            out.update((s, e, "address") for s, e in _windows(text, head.start(), m.end()) if _house_at_end(text[s:e]))
    for m in RUN.finditer(text):
        for s, e in _windows(text, *m.span()):
            if e - s > 4 and text[e - 2] in "'’" and text[e - 1] in "sS":
                e -= 2  # a possessive ending is no part of the name
            piece = text[s:e]
            if piece.count(",") <= 1 and (piece[-1] != "." or piece[-3] in " \u00a0") and _may_begin(piece.split()[0]) and len(piece) - piece.count(" ") > 4:
                out.add((s, e, "name"))
    return sorted(out)


def _shape(piece: str) -> str:
    """Digits as 0, letters as A or a, dashes and spaces alike."""
    return "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "-" if c in "‐‑‒–" else " " if c in " \u00a0" else c for c in piece)


def _loud(piece: str) -> bool:
    """Whether the words of a piece are in capitals."""
    letters = [c for c in piece if c.isalpha()]
    return len(letters) > 1 and all(c.isupper() for c in letters)


@lru_cache(maxsize=2)
def lexicon(paths: tuple[str, ...] = VOCABULARIES) -> dict[str, str]:
    """Words of the vocabularies: 'w' known in lower case, 'p' known with a capital only (mostly proper nouns)."""
    out: dict[str, str] = {}
    for path in paths:
        with open(path, "rb") as f:
            for line in f:
                token = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
                word = token[1:]
                if token[0] == " " and len(word) > 2 and word.isalpha():
                    if word.islower():
                        out[word] = "w"
                    elif word[0].isupper() and word[1:].islower():
                        out.setdefault(word.lower(), "p")
    return out


@lru_cache(maxsize=100_000)
def word_class(word: str) -> str:
    """What the model may see of a word outside a span: its class or its form."""
    low = word.lower()
    if low in CUES:
        return CUES[low]
    if low in FUNCTION:
        return low
    if not word[0].isalnum():
        return word
    return "0" if word[0].isdigit() else "Aa" if word[0].isupper() else "a"


class Context:
    """Word classes around the positions of one text, each looked up once."""

    def __init__(self, text: str, words: dict[str, str]):
        self.text, self.words, self._before, self._after = text, words, {}, {}

    def before(self, start: int) -> tuple[list[tuple], str]:
        if start not in self._before:
            near = WORD.findall(self.text[max(0, start - 48) : start])[-5:]
            if start > 48 and near:  # the first one may be cut
                near = near[1:]
            seen = [word_class(w) for w in near]
            line = seen[len(seen) - seen[::-1].index("\n") :] if "\n" in seen else seen
            one, two = (["^", "^", *seen])[-1], (["^", "^", *seen])[-2]
            self._before[start] = [("l1", one), ("l2", two, one), *sorted({("near", c) for c in line if c[0] == "<"})], one
        return self._before[start]

    def after(self, end: int) -> tuple[list[tuple], str]:
        if end not in self._after:
            seen = [*(word_class(w) for w in WORD.findall(self.text[end : end + 30])[:2]), "$", "$"]
            gap = self.text[end : end + 1]
            self._after[end] = [("r1", seen[0]), ("r2", seen[0], seen[1]), ("gap", gap if not gap.isalnum() else "x")], seen[0]
        return self._after[end]


def _number_features(text: str, start: int, end: int, kind: str, cues: list[tuple]) -> list[tuple]:
    piece = text[start:end]
    shape = _shape(piece)
    lens = tuple(len(g) for g in ZEROS.findall(shape))
    head = piece[:2] if piece[0] in "+(0" else piece[0] if kind == "phone" else ""
    # runs of digits matter by length, so one format with other separators looks alike
    sep = "".join(sorted(set(SEPARATORS.sub("", shape))))
    plain = (sep, lens, head[:1] if kind == "phone" else shape if len(lens) < 2 else "")
    out = [("lens", lens), ("digits", sum(lens)), ("start", head), ("sep", sep), ("form", plain)]
    out += [("form&", c[1], lens) for c in cues] or [("bare", lens)]
    out += [("form0", sep, len(lens), sum(lens), head[:1])]
    if kind == "id_number":
        out += [("shape", shape)]
    out += [("cut",)] if CUT_AFTER.match(text, end) else []
    out += [("cutleft",)] if CUT_BEFORE.search(text[max(0, start - 2) : start]) else []
    out += [("ip",)] if IPV4.fullmatch(piece) else []
    out += [("date",)] if DATE.match(piece) else []
    return out


def _email_features(piece: str) -> list[tuple]:
    host = AT.split(piece)[-1]
    tld = DOT.split(host)[-1]
    sign = AT.search(piece)[0].strip()
    worded = sign.lower() == "at"
    return [("tld", tld.isalpha() and len(tld) > 1), ("at", "at" if worded else sign[:1]), ("plain", worded, "." in host or "．" in host), ("digits", any(c.isdigit() for c in tld))]


@lru_cache(maxsize=200_000)
def _traits(low: str) -> tuple[bool, bool, bool, bool, bool, bool, bool]:
    """Of a word of a name: initial, given name, ordinary, technical, function or cue word, surname ending, German noun ending."""
    return (
        len(low) == 2 and low[1] == ".", low.split("-")[0] in GIVEN, low in ORDINARY, low in TECHNICAL or low in CALENDAR,
        low in FUNCTION or low in CUES, bool(SURNAME.search(low)), bool(GERMAN_NOUN.search(low)),
    )


def _name_features(text: str, start: int, end: int, piece: str, toks: list[str], low: list[str], r1: str, words: dict[str, str]) -> list[tuple]:
    inverted = "," in piece
    order = low if not inverted else [*low[1:], low[0]]
    known = [_traits(w) for w in order]
    given = known[0][1]
    ordinary, technical = sum(t[2] for t in known), sum(t[3] for t in known)
    odd = _traits(low[0])[4] + _traits(low[-1])[4]
    # what the lexicon has of each token: an ordinary word, a proper noun, or nothing
    held = ["i" if t[0] else "o" if t[2] or t[3] else words.get(w.split("-")[0], "r") for w, t in zip(order, known, strict=True)]
    form = "/".join("I" if len(t) == 2 and t[1] == "." else "U" if t.isupper() else "C" if t[0].isupper() else "l" for t in toks)
    out = [("case", form), ("given", given), ("inverted", inverted), ("inverted", inverted, given), ("ordinary", ordinary), ("technical", technical), ("odd", odd), ("initials", sum(t[0] for t in known))]
    out += [("held", given, "".join(held[:3])), ("ends", given, held[0], held[-1]), ("last", held[-1]), ("first", held[0]), ("common", sum(h in "wo" for h in held), len(held))]
    out += [("known", given, ordinary, technical > 0, odd > 0), ("surname", known[-1][5], given), ("noun", sum(t[6] for t in known), given)]
    out += [("label", r1, given)] if r1 in ("<group>", "<title>", "<thing>") else []
    out += [("part", next((w for w in low[1:-1] if w in FUNCTION), "")), ("givens", sum(t[1] for t in known))]
    out += [("shouted", _loud(text[max(0, start - 12) : start]), _loud(text[end : end + 12]))] if piece.isupper() else [("spoken",)]
    if inverted:
        out += [("comma", "end" if piece.find(",") > piece.rfind(" ") else len(piece[: piece.find(",")].split()))]
    return out


def _address_features(piece: str, low: list[str], follows: bool, before: bool) -> list[tuple]:
    first = piece[0].isdigit()
    tail = low[-1] if first else low[-2] if low[-1].isdigit() or len(low[-1]) < 5 else low[-1]
    ends = low[-1].rstrip(".") in STREET_END
    starts = low[0] in STREET_START or len(low) > 1 and first and low[1] in STREET_START
    fused = any(STREET_FUSED.search(w) for w in low[:-1]) and not first
    inner = sum(w in STREET_END for w in low[1:-1])
    known = sum(w in TECHNICAL for w in low)
    out = [("first", first), ("kinds", ends, starts, fused, first), ("street", ends or starts or fused), ("tail", tail in STREET_END), ("inner", inner), ("known", known, ends or starts or fused)]
    return out + [("streetfollows", ends, follows), ("startbefore", starts, before), ("fusedbefore", fused, before), ("fusedfirst", bool(STREET_FUSED.search(low[0])), len(low))]


def features(text: str, start: int, end: int, kind: str, context: Context) -> list[tuple]:
    """Features of one whole span."""
    piece = text[start:end]
    before, l1 = context.before(start)
    after, r1 = context.after(end)
    out = [("bias",), *before, *after]
    if kind in ("phone", "id_number"):
        return out + _number_features(text, start, end, kind, before[2:])
    if kind == "email":
        return out + _email_features(piece)
    toks = piece.replace(",", "").split()
    low = [t.lower() for t in toks]
    # a capital right before or after belongs to the same run
    follows, preceded = bool(CAPITAL_NEXT.match(text, end)), bool(CAPITAL_BEFORE.search(text[max(0, start - 30) : start]))
    out += [("n", len(toks)), ("follows", follows), ("before", preceded)]
    out += [("linestart",)] if start == 0 or text[start - 1] == "\n" else []
    out += [("lineend",)] if end == len(text) or text[end] in "\n<" else []
    if kind == "name":
        out += [("sentence",)] if l1 in (".", "?", "!", "^", "\n", ":", ">") else []
        return out + _name_features(text, start, end, piece, toks, low, r1, context.words)
    return out + _address_features(piece, low, follows, preceded)


def _lattice(text: str, words: dict[str, str]) -> list[tuple[int, int, str, list[tuple]]]:
    context = Context(text, words)
    return [(s, e, k, [(k, *f) for f in features(text, s, e, k, context)]) for s, e, k in candidates(text)]


class Model:
    """Weights of each kind by feature, and the lexicon that the features look words up in."""

    def __init__(self, weights: dict[tuple, float], words: dict[str, str]):
        self.words = words
        self.weights: dict[str, dict[tuple, float]] = {k: {} for k in KINDS}
        for (kind, *f), w in weights.items():
            self.weights[kind][tuple(f)] = w


def decode(text: str, model: Model) -> list[tuple[int, int, str]]:
    """Best joint set of spans: Viterbi over span boundaries."""
    spans = []
    proposed = candidates(text)
    context = Context(text, model.words)
    for s, e, k in proposed:
        get = model.weights[k].get
        score = sum([get(f, 0.0) for f in features(text, s, e, k, context)])
        if score > 0:  # a span scoring at most 0 never beats leaving its text outside
            spans.append((e, s, k, score))
    if not spans:
        return []
    spans.sort()
    bounds = sorted({b for e, s, _, _ in spans for b in (s, e)})
    at = {b: i for i, b in enumerate(bounds)}
    best, back = [0.0] * len(bounds), [None] * len(bounds)
    ending: dict[int, list] = {}
    for e, s, k, score in spans:
        ending.setdefault(at[e], []).append((at[s], s, e, k, score))
    for i in range(1, len(bounds)):
        best[i] = best[i - 1]
        for j, s, e, k, score in ending.get(i, ()):
            if best[j] + score > best[i]:
                best[i], back[i] = best[j] + score, (j, s, e, k)
    out, i = [], len(bounds) - 1
    while i > 0:
        if back[i]:
            j, s, e, k = back[i]
            out.append((s, e, k))
            i = j
        else:
            i -= 1
    return out[::-1]


def _add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log1p(math.exp(-abs(a - b)))


def _marginals(spans: list, scores: list[float]) -> list[float]:
    """Probability of each span under the model (forward-backward)."""
    bounds = sorted({b for s, e, *_ in spans for b in (s, e)})
    at = {b: i for i, b in enumerate(bounds)}
    n = len(bounds)
    ending, starting = [[] for _ in range(n)], [[] for _ in range(n)]
    for i, (s, e, *_) in enumerate(spans):
        ending[at[e]].append((at[s], scores[i]))
        starting[at[s]].append((at[e], scores[i]))
    alpha, beta = [0.0] * n, [0.0] * n
    for i in range(1, n):
        a = alpha[i - 1]
        for j, sc in ending[i]:
            a = _add(a, alpha[j] + sc)
        alpha[i] = a
    for i in range(n - 2, -1, -1):
        b = beta[i + 1]
        for j, sc in starting[i]:
            b = _add(b, beta[j] + sc)
        beta[i] = b
    z = alpha[-1]
    return [math.exp(min(0.0, alpha[at[s]] + scores[i] + beta[at[e]] - z)) for i, (s, e, *_) in enumerate(spans)]


def fit(examples: list[tuple[str, list[tuple[int, int, str]]]], words: dict[str, str], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> dict[tuple, float]:
    """Conditional maximum likelihood by AdaGrad over the examples."""
    data = [(_lattice(t, words), set(map(tuple, gold))) for t, gold in examples]
    weights: dict[tuple, float] = {}
    grown: dict[tuple, float] = {}
    order = list(range(len(data)))
    for epoch in range(epochs):
        random.Random(epoch).shuffle(order)
        for i in order:
            spans, gold = data[i]
            if not spans:
                continue
            scores = [sum(weights.get(f, 0.0) for f in fs) for *_, fs in spans]
            for (s, e, k, fs), p in zip(spans, _marginals(spans, scores), strict=True):
                g = ((s, e, k) in gold) - p
                if abs(g) < 1e-3:
                    continue
                for f in fs:
                    w = weights.get(f, 0.0)
                    step = g - decay * w
                    grown[f] = grown.get(f, 1e-2) + step * step
                    weights[f] = w + rate * step / math.sqrt(grown[f])
    return {f: w for f, w in weights.items() if abs(w) > 1e-3}


@lru_cache(maxsize=1)
def model() -> Model:
    """Weights fitted on the generated sample; the same in every process."""
    from loamgraph.llm.pii_sample import labelled_sentences

    words = lexicon()
    return Model(fit(labelled_sentences(TRAIN_SENTENCES, words), words), words)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, k in spans:
        out += [text[at:s], PLACEHOLDER[k]]
        at = e
    return "".join([*out, text[at:]])


def find_personal(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: Model | None = None) -> DataFrame:
    """``(doc_id, kind, found)``: every piece once per document."""
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(fitted or model())
    kept = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            rows = [(i, k, t[s:e]) for i, t in zip(frame["doc_id"], frame["text"], strict=True) for s, e, k in decode(t, m)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "found"]).astype({"doc_id": "int64"})

    return spread(kept, "doc_id").mapInPandas(run, "doc_id long, kind string, found string").distinct()


def redact_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", fitted: Model | None = None) -> DataFrame:
    """``(doc_id, redacted, n_found)`` for every document; a null text stays null."""
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(fitted or model())
    kept = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            spans = [decode(t, m) if isinstance(t, str) else [] for t in frame["text"]]
            texts = [redact(t, x) if isinstance(t, str) else None for t, x in zip(frame["text"], spans, strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "redacted": pd.Series(texts, index=frame.index, dtype=object), "n_found": [len(x) for x in spans]})

    return spread(kept, "doc_id").mapInPandas(run, "doc_id long, redacted string, n_found int")
