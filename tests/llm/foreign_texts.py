"""Hand-labelled texts whose wording neither the training sample nor the documents share: ``[[kind|piece]]``."""

TEXTS = """
After the storm, [[name|Harriet Bloomquist]] repaired the greenhouse roof herself.
The recipe came from [[name|Tomasz Wierzbicki]], who runs a bakery in the old harbour.
Voicemail for the plumber: [[phone|0161 496 0733]]. He starts at seven.
If the alarm goes off again, the janitor wants to be woken under [[phone|(503) 555-0188]].
Applications can be sent until June to [[email|choir.office@sankt-anna.example]].
[[name|Yolanda Ferrer]] and [[name|Björn Åkesson]] will share the stand at the fair.
Lost: brown suitcase, tag says [[name|Okonkwo, Adaeze]], [[address|88 Larkspur Avenue]].
Der Klavierstimmer heißt [[name|Gernot Pfisterer]] und kommt am Donnerstag.
Bitte klingeln bei [[address|Kastanienallee 14b]], zweiter Stock links.
La profesora de baile, [[name|Remedios Zubiri]], atiende en [[address|Calle Mayor 31]].
The visa desk noted [[id_number|X4459120]] as the passport number of the student.
Her SSN [[id_number|219-09-9934]] appeared on the printout by mistake.
Rehearsal moved. Questions? [[email|tenor_two (at) chorus (dot) example]] knows more.
Our accountant, [[name|S. K. Ramanathan]], retired in March.
Invoice 4471-2290-13 was paid twice, invoice 4471-2290-14 never.
Blue Heron won the rowing cup ahead of Iron Lantern.
The museum shows Evening Harbor and Broken Bridge until autumn.
Chapter 12 Garden Walls explains how ivy climbs.
Flight 2208 left at 10:45 with 163 passengers.
The sensor at 10.44.7.231 stopped answering at 03:17.
Serial 0098-44-7 is stamped on the back of the heater.
Quick Start Guide and Safety Notes are inside the box.
Am Montag fällt die Chorprobe wegen der Renovierung aus.
Das Öffnen von Fenstern ist während der Fahrt verboten.
ISBN 978-3-1614-8410-0 is out of print.
Timestamp 1718220012 marks the end of the recording.
PLEASE KEEP THE DOOR CLOSED DURING THE LECTURE
The winner is [[name|Ngozi Adeyemi-Clarke]]! Tickets: [[phone|+44 20 7946 0123]].
Forward complaints to [[email|m.vandenberg+boats@marina.example]] please.
[[name|PETER VAN HOUTEN]] SIGNED THE LEASE
Her landlord [[name|Giacomo Bellini]] lives in [[address|Via Roma 7]].
Emergency contact: [[name|Aoife Ní Bhriain]] ([[phone|+353 861 234 567]])
Deliver the piano to [[address|5 Orchard Lane]] before noon.
The choir thanks [[name|Kwabena Asante]] for the new organ pipes.
National insurance number [[id_number|QQ 12 34 56 C]] was entered twice.
[[email|grandma.elsie@knitting.example]] wrote: the scarf is ready.
We rented bikes from Silver Wheel and skis from Alpine House.
Version 4.12.0 of the score adds a second trumpet.
My dentist moved from [[address|19 Station Road]] to [[address|240 Elm Drive]].
Kontakt zum Imker: [[name|Ludwig Haslinger]], [[phone|08123 / 445566]].
El DNI [[id_number|48291034K]] no coincide con la firma.
Parcel 8823-110-22 weighs 4 kg.
Sunday market: apples, pears, plums and cherries.
The jury ([[name|Ines Caldeira]], [[name|Marek Dvořák]]) met for two hours.
Page 40 of Winter Stories is torn.
[[name|Oluwaseun Balogun]] scored twenty points on Saturday.
Fax the form to [[phone|212-555-0142]] or walk in.
""".strip().split("\n")


def labelled() -> list[tuple[str, list[tuple[int, int, str]]]]:
    out = []
    for line in TEXTS:
        text, gold = "", []
        for part in line.split("[["):
            if "]]" not in part:
                text += part
                continue
            inside, rest = part.split("]]", 1)
            kind, piece = inside.split("|", 1)
            gold.append((len(text), len(text) + len(piece), kind))
            text += piece + rest
        out.append((text, gold))
    return out
