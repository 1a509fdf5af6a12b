"""Generated labelled sentences for fitting the personal-information model.

Names are made of syllables or drawn from a list of frequent given names, so
the model learns context and form rather than a register of persons.  Half of
the sentences surround their slots with randomly drawn plain words, so that a
span has to be told by its form and by the class of the words around it; the
others come from letters, bookings, clinics, clubs and the like.  Look-alikes
(teams, titles, versions, machine addresses, order numbers, dates) stand in the
same surroundings.  No wording is taken from the documents that are searched.
"""

from __future__ import annotations

import random

from loamgraph.llm.pii import FUNCTION, GIVEN, ORDINARY, STREET_END, TECHNICAL

ONSET = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sch sh sk st t th tr v w y z".split()
VOWEL = "a e i o u ä ö é ei ia ou".split()
CODA = "n r l s nd rk x m lt ck t th".split()
ENDING = "son sen berg burg ski sky ez ini ova ley dale wick quist mann vik mont elli ford ton well feld man ard yan ier".split()
HOSTS = "example.com mail.example.org inbox.test dept.firm.invalid acme.example post.nord.example desk.bureau.test kontor.example".split()
EN = "old work small house often paper light water table window garden winter music letter number morning slowly yellow simple doctor river answer carry wooden summer market village distance travel broken finger button engine carpet kitchen basket pencil weather bottle".split()
DE = "alte Arbeit kleines oft Papier Wasser Tisch Fenster Garten Winter Brief Morgen langsam einfach Fluss Antwort Sommer Markt Dorf Reise Finger Knopf Teppich Korb Wetter Flasche Bruder Stuhl Zug Lampe".split()
ES = "viejo trabajo casa papel agua mesa ventana invierno carta mañana lento simple río respuesta verano mercado pueblo viaje dedo motor cocina cesta tiempo botella hermano silla".split()
THINGS = "order invoice ticket article contract parcel part model shipment batch account item case job version reference".split()
MONTHS = "January February March April May June July August September October November December".split()
GERMAN = "Rechnung Lieferung Vertrag Besprechung Abteilung Heizung Wohnung Bahnhof Fahrplan Kasse Werkstatt Prüfung Bibliothek Küche Anlage Leitung Zahlung Übersicht Versicherung Auswahl Bestand Eingang Katalog Termin Ausflug".split()


GERMAN_VERBS = "Kochen Waschen Backen Malen Bauen Putzen Einkaufen Reparieren Sortieren Verpacken Bezahlen Anmelden Abholen Messen Singen Schneiden Ausfüllen Bestellen".split()


class Maker:
    def __init__(self, seed: int, words: dict[str, str]):
        self.r = random.Random(seed)
        # ordinary words of the lexicon, for names of teams, features and titles
        self.known = sorted(w for w, kind in words.items() if kind == "w" and len(w) > 3 and w not in GIVEN)
        self.proper = sorted(w for w, kind in words.items() if kind == "p" and len(w) > 3 and w not in GIVEN)
        self.either = sorted(w for w in GIVEN if words.get(w) == "w")  # given names that are ordinary words too
        self.given, self.ordinary, self.technical = sorted(GIVEN), sorted(ORDINARY), sorted(TECHNICAL)
        self.small = sorted(w for w in FUNCTION if w.isascii())
        self.street_end = sorted(STREET_END)

    # --- personal pieces

    def syllables(self, n: int) -> str:
        r = self.r
        return "".join(r.choice(ONSET) + r.choice(VOWEL) + (r.choice(CODA) if r.random() < 0.4 else "") for _ in range(n)).capitalize()

    def first(self) -> str:
        r = self.r
        return r.choice(self.given).capitalize() if (x := r.random()) < 0.5 else r.choice(self.proper).capitalize() if x < 0.62 else self.syllables(r.choice((1, 2, 2)))

    def last(self) -> str:
        r = self.r
        x = r.random()
        one = self.syllables(1) + r.choice(ENDING) if x < 0.5 else self.syllables(r.choice((2, 3))) if x < 0.94 else r.choice(self.known).capitalize()
        x = r.random()
        if x < 0.05:
            return "O'" + one
        if x < 0.09:
            return "d'" + one
        if x < 0.18:
            return one + "-" + self.syllables(2)
        return one

    def name(self) -> str:
        r = self.r
        first, last, initial = self.first(), self.last(), lambda: r.choice("ABCDEFGHIJKLMNOPRSTUVW") + "."
        x = r.random()
        if x < 0.12:
            out = f"{last}, {first}"
        elif x < 0.15:
            out = f"{last}, {first} {initial()}"
        elif x < 0.26:
            out = f"{first} {initial()} {last}"
        elif x < 0.31:
            out = f"{first} {r.choice(('van', 'de', 'von', 'van der', 'del', 'di'))} {last}"
        elif x < 0.36:
            out = f"{initial()} {initial()} {last}" if r.random() < 0.5 else f"{initial()} {last}"
        elif x < 0.40:
            out = f"{first} {self.first()} {last}"
        else:
            out = f"{first} {last}"
        return out.upper() if r.random() < 0.08 else out

    def email(self) -> str:
        r = self.r
        f, l = self.first().lower(), self.last().lower().replace("'", "")
        user = r.choice((f"{f}.{l}", f"{f}_{l}", f"{f[0]}{l}", f"{f}-{l}", f"{l}", f"{f}{r.randint(1, 99)}"))
        user += str(r.randint(1, 99)) if r.random() < 0.25 else ""
        user += "+" + r.choice(("list", "news", "work")) if r.random() < 0.15 else ""
        host, x = r.choice(HOSTS), r.random()
        if x < 0.6:
            out = f"{user}@{host}"
        elif x < 0.7:
            out = f"{user} [at] {host.replace('.', ' [dot] ')}"
        elif x < 0.78:
            out = f"{user}(at){host}"
        elif x < 0.85:
            out = f"{user} @ {host}"
        elif x < 0.9:
            out = f"{user} at {host.replace('.', ' dot ')}"
        elif x < 0.95:
            out = f"{user}&#64;{host}" if r.random() < 0.5 else f"{user}%40{host}"
        else:
            out = f"{user} (at) {host.replace('.', ' (dot) ')}"
        return out.upper() if r.random() < 0.08 and "at" not in out.split() else out

    def digits(self, n: int, first: str = "") -> str:
        return first + "".join(self.r.choice("0123456789") for _ in range(n - len(first)))

    def phone(self) -> str:
        """National and international spellings of the United States, Britain, Germany, France, Spain and others."""
        r, d = self.r, self.digits
        area, mid, end = d(3, r.choice("23456789")), d(3, r.choice("23456789")), d(4)
        sep, nb = r.choice("- ."), r.choice((" ", " "))
        forms = [
            f"({area}) {mid}-{end}", f"{area}{sep}{mid}{sep}{end}", f"+1 {area} {mid} {end}", f"+1-{area}-{mid}-{end}", f"1{area}{mid}{end}",
            f"+1{nb}{area}‑{mid}‑{end}", f"+1 ({area}) {mid}-{end}", f"+44 {d(4, '1')} {d(6)}", f"0{d(4, '1')} {d(3)} {d(3)}",
            f"0044 {d(2, '2')} {d(4)} {d(4)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"+49 (0){d(2, r.choice('2346'))} {d(5)} {d(3)}",
            f"+49 {d(3)} {d(7)}", f"0{d(2, r.choice('2346'))} / {d(7)}", f"0{d(3)}-{d(7)}", f"0{d(1, r.choice('123456'))} {d(2)} {d(2)} {d(2)} {d(2)}",
            f"+33 {d(1, r.choice('123456'))} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3, '9')} {d(3)} {d(3)}", f"{d(3, '6')} {d(3)} {d(3)}",
            f"+{d(2, '3')}{d(9)}", f"0{d(3)} {d(6)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"+46 {d(2, '7')} {d(3)} {d(2)} {d(2)}",
        ]
        return r.choice(forms)

    def id_number(self) -> tuple[str, str]:
        """A label and a number that a state gives to a person."""
        r, d = self.r, self.digits
        up = "ABCDEFGHJKLMNPRSTVWXYZ"
        kind = r.choice(("ssn", "ssn", "nino", "passport", "passport", "code", "dni"))
        if kind == "ssn":
            return r.choice(("SSN", "social security number", "social security no.", "Social Security")), r.choice(("{}-{}-{}", "{} {} {}")).format(d(3), d(2), d(4))
        if kind == "nino":
            a, z = r.choice(up) + r.choice(up), r.choice("ABCD")
            return r.choice(("NINO", "national insurance no.", "NI number", "national insurance number")), r.choice((f"{a}{d(6)}{z}", f"{a} {d(2)} {d(2)} {d(2)} {z}"))
        if kind == "passport":
            return r.choice(("passport", "passport no.", "passport number", "travel document", "Reisepass", "pasaporte")), r.choice((f"{r.choice(up)}{r.choice(up)}{d(7)}", f"{r.choice(up)}{d(8)}", f"{r.choice(up)}{r.choice(up)}{d(6)}"))
        if kind == "code":
            return r.choice(("personal code", "personal identity code", "personal no.", "personal id", "personal identification")), f"{d(6)}-{d(3)}{r.choice('0123456789' + up)}"
        return r.choice(("DNI", "identity card", "national id", "documento de identidad")), f"{d(8)}{r.choice(up)}"

    def address(self) -> str:
        r = self.r
        stem = self.syllables(2) if r.random() < 0.5 else r.choice(self.ordinary).capitalize() + r.choice(("", "hurst", "wood", "field", "gate", "moor"))
        n = str(r.randint(1, 999)) + (r.choice("abc") if r.random() < 0.1 else "")
        x = r.random()
        if x < 0.6:
            return f"{n} {stem}{' ' + self.syllables(2) if r.random() < 0.1 else ''} {r.choice(('Street', 'Road', 'Lane', 'Ave', 'Avenue', 'Drive', 'Court', 'Close', 'Place', 'Way', 'Terrace', 'Street'))}"
        if x < 0.78:
            return f"{stem}{r.choice(('straße', 'weg', 'gasse', 'allee', 'platz'))} {n}"
        if x < 0.9:
            return f"{r.choice(('Calle', 'Avenida', 'Plaza', 'Via', 'Camino'))} {r.choice(('', '', 'de '))}{stem} {n}"
        return f"{n} {r.choice(('rue de', 'rue', 'rue du'))} {stem}"

    # --- surroundings and look-alikes

    def filler(self, least: int = 1, most: int = 5) -> str:
        r = self.r
        if (x := r.random()) < 0.7:
            return " ".join(r.choice(EN if (y := r.random()) < 0.4 else self.known if y < 0.55 else THINGS if y < 0.6 else self.small) for _ in range(r.randint(least, most)))
        return " ".join(r.choice(DE if x < 0.85 else ES) for _ in range(r.randint(least, most)))

    def opening(self) -> str:
        f = self.filler(1, 4)
        return f[:1].upper() + f[1:]

    def team(self) -> str:
        r = self.r
        word = lambda: r.choice(self.ordinary if (x := r.random()) < 0.45 else self.known if x < 0.9 else self.technical)
        x = r.random()
        first = r.choice(self.either) if x < 0.06 else r.choice(self.proper) if x < 0.14 else word()
        return f"{first} {word()}".title()

    def feature(self) -> str:
        return " ".join(self.r.choice(self.technical if self.r.random() < 0.5 else self.known) for _ in range(self.r.choice((2, 2, 3)))).title()

    def heading(self) -> str:
        """A title, sometimes with a street word, that is no place."""
        r, end = self.r, self.r.choice(self.street_end).title()
        word, tech = r.choice(self.ordinary).title(), r.choice(self.technical).title()
        return r.choice((f"{word} {tech}", f"{end} {tech}", f"{word} {end} {tech}", f"{word} {end} {tech}", f"{tech} {word} {r.choice(self.technical).title()}", f"{end} {tech} {word}"))

    def version(self) -> str:
        return ".".join(str(self.r.randint(0, 30)) for _ in range(3))

    def shouting(self) -> str:
        return self.filler(2, 9).upper() + self.r.choice(("", ", " + self.filler(2, 5).upper()))

    def german(self) -> str:
        r, n = self.r, self.r.randint(1, 900)
        g, v = lambda: r.choice(GERMAN), lambda: r.choice(GERMAN_VERBS)
        return r.choice(
            (
                f"Die {g()} der {g()} kostet {n} Euro", f"Wegen der {g()} fällt die {g()} aus", f"Zur {g()} gehört eine {g()}", f"Jede {g()} braucht {n} {g()}en",
                f"Ihre {g()} liegt im {g()} bereit", f"Bitte die {g()} und die {g()} mitbringen", f"Ohne {g()} keine {g()}", f"Beim {g()} half ein {g()}", f"{g()} und {g()} sind getrennt", f"Unsere {g()} {n} ist neu",
                f"{g()} des {g()}s", f"{g()} von {g()}en", f"{v()} von {g()}en", f"Beim {v()} von {g()}en {r.choice(DE)}", f"{v()} der {g()}", f"Das {v()} von {g()}en {r.choice(DE)}", f"Den {g()} der {g()}", f"Eine {g()} von {n} {g()}en", f"{r.choice(self.small).title()} {r.choice(('der', 'die', 'den', 'das'))} {g()} {r.choice(DE)}", f"Zum {g()} des {g()}s {r.choice(DE)}",
            )
        )

    def machine(self) -> str:
        """An internet address."""
        r = self.r
        return ".".join(str(r.randint(100, 255) if r.random() < 0.5 else r.randint(0, 99)) for _ in range(4))

    def number(self) -> str:
        """Numbers of things: never of a person."""
        r, d, n = self.r, self.digits, self.r.randint(1, 9000)
        thing = r.choice(THINGS)
        return r.choice(
            (
                f"{thing} {d(4)}-{d(4)}-{d(r.choice((1, 2, 3)))}", f"{thing} number {d(8)}", f"{thing} no. {d(3)}-{d(5)}-{d(2)}", f"{thing} {d(10)}", f"{thing}s {d(3)}-{d(2)}-{d(r.choice((1, 2, 3)))} and {d(3)}-{d(2)}-{d(r.choice((1, 2, 3)))}",
                f"{thing} 00{d(1)}-{d(2)}-{d(r.choice((1, 2, 3)))}", self.machine(), f"address {self.machine()}", f"from {self.machine()}", f"{self.machine()} port {d(4)}", f"node {d(18, '3')}", f"{thing}-{d(4)}-{d(4)}",
                f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)} 1{d(1)}:{d(2)}:{d(2)} INFO {thing}={d(18, '3')}", f"checksum {d(12)}", f"hash {d(11)} {d(9)}",
                f"package {r.choice(EN)}-tools@{self.version()}", f"user {r.choice(EN)}@{r.choice(EN)}", f"@{r.choice(EN)}-{d(6)}", f"{thing} AB-{d(5)} or CD-{d(4)}", f"timestamp {d(10, '17')}", f"size {d(9)} bytes", f"build {self.version()}-{d(8)}",
                f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"card {d(4)} {d(4)} {d(4)} {d(4)}", f"error {d(4)} {d(3)}", f"{d(3)} {d(3)} {d(3)} bytes", f"model AB{d(7)}", f"{thing} AB{d(6)}", f"key {d(6)}-{d(3)}", f"version {self.version()}",
                f"from {n} to {n + 7}", f"{d(3)} - {d(4)} - {d(3)} mm", f"{d(10, '1')} rows", f"row {d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"https://{r.choice(EN)}.example/{d(9)}/{d(10)}",
            )
        )

    def decoy(self) -> str:
        r, t, f = self.r, self.team, self.filler
        x = r.random()
        if x < 0.3:
            return f"{self.opening()} {self.number()} {f()}" if r.random() < 0.8 else self.number()
        if x < 0.41:
            return self.german()
        if x < 0.46:
            return self.shouting()
        h, n = self.heading, r.randint(1, 99)
        return r.choice(
            (
                f"{t()} {f()}", f"{t()} {f()}", f"{self.opening()} {t()} {f()}", f"{self.opening()} {t()}", f"team {t()}", f"the {t()} team", f"das Team {t()} {f()}", f"el equipo {t()} {f()}", f"group {t()} {f()}", f"both {t()} and {t()} {f()}",
                f"{t()} or {t()}", f"ask {t()}", f"by {t()}", f"from {t()} {f()}", f"{t()}: {f()}", f"with {t()}, {f()}", f"{self.feature()} {f()}", f"{self.opening()} {self.feature()} {f()}", f"{self.feature()} and {self.feature()} {f()}", f"{n} {self.feature()} {f()}",
                f"{n} {h()}", f"titles such as {n} {h()} and {n} {h()}", f"chapter {n} {h()} {f()}", f"{self.opening()} {n} {h()} {f()}", f"{n} {h()}, {n} {h()} {f()}", f"see {n} {h()}", f"{n} {r.choice(MONTHS)} {r.randint(1990, 2030)}",
                f"on {r.choice(MONTHS)} {n}", f"{r.choice(MONTHS)} {r.choice(self.ordinary).title()} {f()}", f"# {h()} {n}", f"{h()} {f()}", f"{self.feature()} {self.version()}", f"{n} {t().split()[0]} {f()}", f"{self.opening()} {r.choice(EN).title()} {f()}",
                f"The {r.choice(EN).title()} {r.choice(EN).title()} {f()}", f"{f()}. {r.choice(self.small).title()} {r.choice(EN).title()} {f()}", f"{r.choice(self.small).title()} {t()} {f()}", f"{r.choice(self.small).title()} {r.choice(self.small)} {t()} {f()}",
            )
        )

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        label, number = self.id_number()
        slots = {
            "N": ("name", self.name), "E": ("email", self.email), "P": ("phone", self.phone), "A": ("address", self.address), "I": ("id_number", lambda: number), "T": (None, self.team), "L": (None, lambda: label),
            "D": (None, self.decoy), "W": (None, lambda: str(r.randint(1, 400))), "F": (None, self.filler), "O": (None, self.opening),
        }
        frame = r.choice(BARE if r.random() < 0.55 else FRAMES)
        if r.random() < 0.5:
            frame = r.choice(["{D}. ", "{O}. ", "{O} {W} {F}. ", "- {D}.\n", "- {O} {F}.\n- ", "- ", "{W}: ", "> ", "<p>", "<li>", "# {D}\n\n", "{D}\n", "* "]) + frame
        if r.random() < 0.6:
            frame += r.choice([" {D}.", "\n{D}.", "</p>\n<p>{D}.", "\n\n- {D}.", " {O} {W}.", " {O} {F}.", " The {T} {F}.", " {O}, {F}.", "; {F}."])
        text, gold, rest = "", [], frame
        while rest:
            a = rest.find("{")
            if a < 0:
                text += rest
                break
            text += rest[:a]
            kind, make = slots[rest[a + 1]]
            piece = make()
            if kind:
                gold.append((len(text), len(text) + len(piece), kind))
            text += piece
            rest = rest[a + 3 :]
        return text, gold


BARE = [
    "{O} {N} {F}.", "{N} {F}.", "{N} {F} {F}.", "{N} {F} {W} {F}.", "{N} {F} {P}.", "{O} {F} {N}.", "{O} {N}, {F}.", "{O} {N} and {N} {F}.", "{O}: {N}", "{N}\n", "{O} {N} ({E}) {F}.", "{O} {N} <{E}> {F}.", "{N} <{E}>", "{O} {E} {F}.", "{O}: {E}", "{E}, {E}", "{E}; {E}", "{O} {E}.",
    "{O} {P} {F}.", "{O}: {P}", "{O} {P}.", "{P} {F}.", "{O} {P} or {P}.", "{O} {N}, {P}.", "{O} {N} {F} {P} {F}.", "{O} {A} {F}.", "{O}: {A}", "{O} {A}.", "{A}\n", "{A}, {F}.", "{O} {A} {F} {A}.", "{N}, {A}", "{O} {N}, {A}.",
    "{O} {L} {I} {F}.", "{O} {L}: {I}.", "{L} {I}", "{O} ({L}): {I}.", "{O} {F} {L} {F} {I}, {F}.", "{O} {I} ({L}).", "{N}, {L} {I}", "{O} {L} {I} {F} {P}.", "{T} {F} {N}.", "{O} {T} {F} {P}.", "{N} {F} {T}.", "{D}.", "{D}.", "{D}. {D}.", "{D}, {F} {T}.", "{D}; {D}.", "{D}.\n{D}.",
    "{N}\n{A}\n{P}", "{O},\n{N}\n{A}\n{O} {P}\n", "{N}\n{P}\n{E}\n", "{O} {N} {F} {E} {F} {P}.",
]

FRAMES = [
    "Dear {N},", "Hello {N}, {F}.", "Mr {N} booked a double room.", "Mrs {N} cancelled her booking.", "Dr. {N} sees patients on Monday.", "Yours faithfully,\n{N}\n", "Yours truly\n{N}\n{A}\n", "Cheers, {N}", "Thanks, {N}", "Kind regards\n{N}\n{P}", "Sincerely yours,\n{N}\n{A}\nMobile: {P}",
    "From: {N} <{E}>\nTo: {E}\nCc: {E}", "On Friday {N} <{E}> answered:", "Email: {E}", "Drop a line to {E}.", "Invitations went out to {E} and {E}.", "Unsubscribe {E} from the newsletter.", "Login: {E}", "The bill was mailed to {E}.", "Correo: {E}", "Meine Mailadresse lautet {E}.", "Puede escribir a {E}.",
    "Telephone: {P}", "Tel. {P}", "Mobile {P}, fax {P}", "Our hotline is {P}.", "Ring the surgery on {P}.", "Text {P} to vote.", "Dial {P} for the front desk.", "Rückruf unter {P} erbeten.", "Handy: {P}", "Mi móvil es el {P}.", "Llámame al {P}.", "Reception: {P}", "You can reach the coach on {P}.", "She left her number, {P}, with the nurse.", "He answers on {P} after six.",
    "{N} sang at the wedding.", "{N} plays the violin.", "The goal was scored by {N}.", "Photo: {N}", "Translated by {N}", "Coach {N} trained the juniors.", "A speech by {N} closed the evening.", "{N} and {N} won the doubles.", "Minutes taken by {N}.", "Present: {N}, {N}, {N}.", "Director: {N}", "Employee: {N}", "Patient: {N}\nBorn: 1980", "Guest name: {N}", "Teacher {N} called in sick.", "We congratulate {N} on the birth.", "according to witness {N}, the car stopped",
    "Verfasst von {N}.", "Gemalt von {N}, {F}.", "{O} gebaut von {N} {F}.", "Übersetzt von {N} und {N}", "ein Lied von {N}", "Foto von {N}, {F}.", "{F} besucht von {N}.", "Escrito por {N}.", "una foto de {N}, {F}", "{O} pintado por {N} {F}.",
    "Signed: {N}", "Herr {N} hat gekündigt.", "Frau {N} zieht um.", "Vielen Dank an {N}!", "Der Arzt {N} ist verreist.", "El profesor {N} llegó tarde.", "La doctora {N} atiende hoy.", "Firmado: {N}", "Viele Grüße\n{N}\n{A}\n", "Un saludo,\n{N}\n{P}", "My neighbour {N} feeds the cat.", "Tell {N} that dinner is ready.", "the lawyer of {N} objected", "{N}'s dentist retired.",
    "The parcel goes to {A}.", "We live at {A}.", "Meet me outside {A}.", "The bakery at {A} opens at six.", "A flat in {A} is to let.", "Wir wohnen in der {A}.", "Anschrift: {A}", "Domicilio: {A}", "Vivo en {A}.", "The taxi waited at {A}.", "Home address: {A}", "They sold {A} last spring.", "Billing: {N}, {A}", "Nouvelle adresse: {A}", "Die Praxis in der {A} schließt.", "Pick up the keys at {A} and return them to {A}.", "a fire at {A}",
    "Her {L} is {I}.", "{L}: {I}", "Enter your {L} ({I}) below.", "His {L} {I} was stolen.", "Please copy the {L} {I} onto the form.", "{N} showed {L} {I} at the border.", "The clinic stored {L} {I}.", "Nummer ({L}): {I}.", "Con {L} {I}.", "He wrote {I} as his {L}.",
    "The {T} choir rehearses on Tuesday.", "{T} beat {T} at home.", "{N} of {T} scored twice.", "{T} welcomes {N}.", "Sponsored by {T}.",
]


def labelled_sentences(n: int, words: dict[str, str], seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    maker = Maker(seed, words)
    return [maker.sentence() for _ in range(n)]
