"""python -m ledgerlark.llm.pii_train MINUTES [more]: trains the model on labelled texts made by rule (or trains it on), and
writes pii_model.npz.

Texts are made of carriers with alternatives, of records (JSON, tables, headers, key-value lines) and of loose words around a
detail, in English, German and Spanish. Names are common ones or invented from syllables; numbers, addresses and mailboxes
follow public formats. Half of the texts hold traps: numbers of the same shape with other meanings, products, places,
organisations, given names alone, words that are also names, remotes, handles and pins. Loose words are those of public
tokenizers' vocabularies, read from TOKENIZERS, beside the short lists here.
"""

from __future__ import annotations

import base64
import multiprocessing as mp
import os
import random
import re
import sys
import time
from functools import cache
from pathlib import Path

import numpy as np

from ledgerlark.llm.pii_model import KINDS, PAD, Model, encode, loss_and_grad, segments

OUT = Path(__file__).with_name("pii_model.npz")
TOKENIZERS = Path(os.environ.get("LEDGERLARK_TOKENIZERS", "/opt/tokenizers"))
HIDDEN, BATCH, SEED = 48, 64, 17

GIVEN = """Aaron Abigail Ahmed Aisha Alan Alejandro Alice Amina Amy Ana Andrea Andreas Andrew Angela Anita Anna Anne Anne-Marie Anthony Antonio Arthur Ashley Barack Barbara Beatriz Ben Bernd
Björn Brian Brigitte Camila Carlos Carmen Catherine Charlotte Chen Chloé Christian Christine Claudia Colin Craig Daniel David Deborah Diego Dieter Dmitri Dorothea Edward Elena Elizabeth Emily Emma Eric Esther Eva
Fatima Felipe Fiona Florian Francisco Frank Friedrich Gabriel George Giulia Gloria Grace Günther Hannah Hans-Peter Harold Heike Heinz Helen Henry Hiroshi Holly Hope Ian Ines Ingrid Isabel Ivan Jack Jacob
James Jan Jane Jason Javier Jean-Pierre Jennifer Jörg John Jonas Jorge José Joy Juan Julia Jürgen Karen Karl Kate Katja Kenji Kevin Klaus Laura Leon Lily Linda Lisa Lucía Luis Lukas Mai Manuel Marc
Marcus Margaret Maria María Mark Martin Mary Matthew Max May Mehmet Michael Miguel Mohammed Monika Nadia Nancy Natalia Nia Nicole Noah Nora Olga Oliver Olivia Omar Oscar Pablo Patricia Paul Pedro Peter
Philip Priya Rachel Raúl Rebecca Robert Rosa Rose Sabine Sally Samuel Sandra Sara Sean Siobhán Sofía Sophie Stefan Stephen Susan Sven Tanja Teresa Thomas Tim Tom Ulrich Uwe Vera Victor Will Yuki Zoë""".split()
FAMILY = """Adams Ahmed Alvarez Anderson Bailey Baker Bauer Becker Bell Bennett Blanco Brandt Brooks Brown Campbell Carter Castillo Castro Chen Clark Cohen Cooper Cruz Davies Davis Diaz Díaz Dubois
Edwards Engel Evans Fernández Fischer Fisher Flores Foster Frank Fuchs García Gómez González Gray Green Gupta Gutiérrez Hall Harris Hartmann Hernández Hoffmann Hughes Ivanova Jackson Jansen Jiménez Johnson Jones
Kaiser Keller Kelly Khan Kim King Klein Kowalski Krause Kumar Lange Lee Lehmann Lewis López Ludwig MacDonald Maier Marín Martin Martínez Mayer McCarthy Meyer Miller Molina Moore Morales Moreno Morgan Morris Müller
Murphy Nakamura Navarro Nguyen Novak Obama Okafor Olsen Ortega Ortiz Owusu Parker Patel Pereira Pérez Peters Petrov Phillips Popescu Price Ramírez Ramos Reed Reyes Richardson Rivera Roberts Robinson Rodríguez Rogers
Romero Rossi Roth Ruiz Russell Ryan Sánchez Sanders Santos Sato Schäfer Schmidt Schneider Schröder Schulz Schwarz Scott Shaw Silva Simon Singh Smith Sørensen Stewart Suárez Sullivan Suzuki Taylor Thompson Torres Turner
Vargas Vega Vogel Wagner Walker Walsh Ward Watanabe Watson Weber Weiß White Williams Wilson Winkler Wójcik Wolf Wood Wright Yılmaz Young Zhang Ziegler Zimmermann""".split()
PARTICLE = "van von de de_la del van_der di du le zu von_der van_den bin al dos".split()
SYL = "ba bel bo bri cam cor da del dor dra el en fa fen fro ga gil gor ha hil hum il in jo kal ker kor la lem lo mar mel mi mon na nel nor o or pa pel per qua ra rem ro sal sel sta ta tel thor tor ul ul va ven vol wa wen wil xan ya zel zor".split()
ENDING = "a ard by ck dale den dt er es ey field ford gate ham hart i in ini is ka ke ker land le ler ley man mann mark mer mont ner o off on ov ova ow ri ric s sen ski smith son stad stein ström t ten ton tt ward well wick worth y z ánez ález ér ín ík ña øy ücker ämmer öhler ůn ć".split()
WORDS = {
    "en": """the a this that each every some no any our their its we they it he she you who which and or but so because while until after before when where if then also still already again never always often only just
    of in on at by for from with without over under between into about is was are were has had will would can could may must should does did gets keeps makes takes gives needs wants shows holds moves sends reads writes opens closes checks counts adds
    list note page report team office desk shop road house garden school train letter parcel table window door key code file record entry batch order price value score limit budget summer winter week month year morning evening number name
    new old small large green blue quick slow open empty full late early first last second next final clear dark heavy light simple hard safe wrong right""".split(),
    "de": """der die das ein eine kein jede unser ihr wir sie er es man und oder aber weil während bis nach vor wenn dann auch noch schon wieder nie immer oft nur in an auf bei für von mit ohne über unter zwischen ist war sind hat wird kann muss soll
    hält macht nimmt gibt braucht zeigt liest schreibt öffnet prüft zählt Liste Notiz Seite Bericht Gruppe Büro Tisch Haus Schule Zug Brief Paket Fenster Tür Datei Eintrag Auftrag Preis Wert Grenze Sommer Winter Woche Monat Jahr Morgen Abend
    neue alte kleine große grüne leere volle späte frühe erste letzte nächste klare schwere einfache falsche""".split(),
    "es": """el la los las un una cada ningún nuestro su y o pero porque mientras hasta después antes cuando donde si también aún ya nunca siempre solo de en con sin sobre entre por para es era son tiene había será puede debe hace toma da
    necesita muestra lee escribe abre cierra cuenta lista nota página informe equipo oficina mesa casa escuela tren carta paquete ventana puerta archivo registro pedido precio valor límite verano invierno semana mes año mañana tarde
    nuevo vieja pequeño grande verde vacío lleno tarde primero último claro pesado simple""".split(),
}
TECH = "cache queue parser index router worker scheduler builder gateway proxy broker loader mapper reader writer monitor planner engine bridge buffer agent relay shell socket stack ledger mirror store guard keeper hub".split()
PRE = "data event user mail task node text image stream log auth token batch search sync edge core file web time byte job rate graph unit query".split()
STREET_EN = "Main High Church Park Oak Maple Cedar Elm Washington Lincoln Lake Hill Victoria Queen's King's Albert Mill Station School Green West North_End South_Park Old_Post Long_Meadow Saint_James St._Mary's Upper_Bridge River Sunset Pine_Ridge 1st 2nd 5th 23rd Ninth Rose Martin_Luther_King Dr._Miller April Hope Bishop's Ferry Orchard".split()
WAY = "Street St Avenue Ave Road Rd Lane Ln Close Row Mews Quay Terrace Drive Dr Crescent Way Boulevard Blvd Place Court Ct Square Gardens Walk Hill Parkway Grove Rise".split()
TOWN_EN = "London Springfield Leeds Bristol York Portland Austin Cambridge Dover Chicago Boston Denver Manchester Lower_Hutton Great_Barford Stoke-on-Trent New_Haven East_Grinstead Santa_Fe Port_Angeles San_Diego Bath Ely King's_Lynn Oakland".split()
STREET_DE = "Haupt Bahnhof Schul Garten Linden Berg Kirch Wald Goethe Schiller Mozart Rosen Mühlen Eichen Wiesen Birken Markt Hafen Ring Ufer Brunnen Kloster Sonnen".split()
WAY_DE = "straße str. weg gasse allee platz ufer ring damm steig tor".split()
STREET_DE2 = "Am_Markt An_der_Brücke Unter_den_Linden Alter_Damm Am_Alten_Hof Zum_Hafen Lange_Straße Alte_Gasse Neuer_Weg Kurze_Str. Im_Winkel Auf_der_Höhe Am_Bach".split()
TOWN_DE = "Berlin Hamburg München Köln Bad_Homburg Freiburg Neustadt Leipzig Kiel Ulm Erfurt Altenburg Neuruppin Halle_(Saale) Marburg Wels".split()
STREET_ES = "Mayor del_Sol de_la_Paz San_Juan Real de_los_Olmos Alcalá Nueva del_Río_Viejo de_las_Flores Cervantes Bolívar Ancha Larga del_Molino Gran_Vía".split()
WAY_ES = "Calle C/ Avenida Avda. Plaza Paseo Camino Ronda Travesía Calle_de".split()
TOWN_ES = "Madrid Sevilla Granada Valencia San_Sebastián La_Coruña Vigo Cádiz Santa_Cruz Toledo Villanueva Ávila Burgos Puerto_Real".split()
PLACE = "New_York_City San_Francisco United_Nations United_States Los_Angeles South_Africa Great_Britain Bad_Homburg Buenos_Aires Hyde_Park Lake_Michigan Black_Forest Mount_Everest North_Sea Costa_Rica El_Salvador European_Union Supreme_Court General_Assembly House_of_Commons Second_World_War Red_Cross Wall_Street Silicon_Valley Rio_Grande Middle_East White_House".split()
ROLE = "Senior_Engineer Chief_Executive Vice_President Product_Manager Lead_Designer Head_of_Sales Customer_Success Project_Lead Sales_Director Managing_Partner Team_Lead Office_Manager".split()
THING = "Mosaic Falcon Grace Hope Summer Thunder Crystal Silver Golden Quantum Rapid Quarry Copper Meadow Harbor Phoenix Sierra Atlas Victoria Jasmine Ruby April Rose Martin Franklin Kettle".split()
THING2 = "Engine Ledger Index Parser Period Limit Queue Report Budget Release Protocol Suite Studio Cloud Cache Score Row_Limit Framework Platform Widget Policy Dashboard Service Library".split()
BODY = "General Supreme National Royal Central Federal Annual Public Regional Upper Northern Southern Western Eastern Local Joint Senior Digital Medical Technical Open Global Common Internal Final Daily Grand Quarterly Civil Social".split()
BODY2 = "Assembly Court Council Bank Museum Report Committee Agency Railway Institute Meeting Office Review Board Archive Library Army Party Union Market Edition Audit Station Theatre Cup Budget Policy Hospital Academy League Forum".split()
ORG = "Ltd Inc GmbH & AG S.A. LLC Holdings Group & Sons Bank Foundation University Hospital Partners".split()
DOMAIN = "mail web post corp lab shop office cloud data north sun blue river stone".split()
TLD = "com org net de es io co.uk example test invalid info edu eu ac.uk".split()
DEVICE = "Shard Lot Invoice Batch Order Part Serial Build Ticket Case SKU Container Pallet Version Revision Window Track Range Item Model Room Gate Section Sample Page Chunk Slot Partition Lieferung Rechnung Auftrag Los Pedido Factura Lote Tramo".split()
UNIT = "bytes rows tokens seconds items files pages records points calls lines units euros retries packets hits".split()

# Carriers. {N} name {S} after a title {A} address {P} phone {E} email {I} id are details; other slots are not. [a|b] is a choice.
POS = """
my [phone |cell |][number|no.] is {P}{x}[, thanks| and I live at {A}|]
[You can reach|Reach|Ring|Please call|Text|Try|Phone] {G} [on|at|under] {P}{x}[.| any time.| {W}.]
[Call|Dial|Ring] {P}{x} [if|when|before|once] {W}
The [old|new|direct|emergency] line[ of {c}|] is {P}{x}; the other one was {P}.
[Fax|Tel.|Phone|Tel|Telephone|Mobile|Cell|T|Ph]: {P}{x}
his number is {P}[, not {n4}|]
A message went to {P}{x} at {hm}[ but not to {n6}|].
{n1}[)|.|:] {P}{x} [rings|is answered|belongs] [at the|in the] {W}
[Please ignore|Remove|Delete|Drop|Don't use] {P}{x}[; use {P} instead| from the list|].
{N}, [tel.|phone|mobile] {P}{x}[, mail {E}|]
My [social security number|SSN|tax number|passport number|national insurance number|ID number] is {I}[.|, please keep it safe.]
[Passport|Passport no.|SSN|Social security number|NI number|National ID|Tax ID|Taxpayer ID|Identity card|Driver's licence|Licence|DNI|NIE|Personal ID|ID|ID card|Citizen no.|Insurance no.|NHS number] {I} [was|is|got] [copied|pasted|printed|found|stored|leaked|written] {W}
[Person|Applicant|Citizen|Claimant|Subject|Patient|Employee|Holder|Insured] {I}[ asked for a copy| wants a copy|, see file {n4}]
The [card|visa|permit|account|file] of [the officer|the clerk|{N}] [is registered|was filed|was made out] [under|as] {I}[, keep it private|].
[Her|His|Their|The] [passport|identity card|tax id|social security] [is|reads|has the number] {I}[, born {date}|].
Der [Ausweis|Reisepass|Führerschein] {I} gehört {N}.
[Steuernummer|Ausweisnummer|Versicherungsnummer|Steuer-ID|Personalausweis]: {I}
Die Sozialversicherungsnummer lautet {I}.
El [DNI|NIE|pasaporte|número de identidad] [de {N} es|es|que figura es|indicado:] {I}[.|, a nombre de {N}.]
[Titular|Solicitante]: {N}, [DNI|NIE|pasaporte] {I}
[Write|Mail|Send it|Forward this|Reply] to {E}[.|, please.| or call {P}.| before {date}.]
[Contact|Email|E-mail|Mail|Address|Contacto|Kontakt|Correo]: {E}
[cc|CC|bcc|to] {E}, {E}[ about {W}|]
[From|To|Author|Signed-off-by|Reviewed-by|Co-authored-by|Reported-by|Cc]: {N} <{E}>
<mailto:{E}> [is|was] {W}
https://[forms|app|track|go].{word}.example/[u|join|s|r]?[mail|email|to|user]={E}[&id={n4}|]
({E}) or "{E}"
[Schreiben Sie|Schreibt] an {E} oder [rufen Sie|ruft] {P}{x} an.
[Escriba|Escríbeme|Envíe la carta] a {E} [o llame al|y llame al] {P}{x}.
{N} [said|told us|wrote|argued|decided|ruled|thinks|confirmed|noted] that {W}
{N} and {N} [met|argue|agreed|disagree|talked|wrote] [about|over|whether|on] {W}
[Yesterday|Today|Last week|On Monday|In {year}|Later|Recently] {N} [met|called|joined|left|visited|replaced] {W}
[Ask|Tell|Invite|Thank|Ping|Ask for|Notify] {N}[, please| about {W}| if {W}|].
[Kind regards|Best regards|Yours sincerely|Best wishes|Cheers|Thanks|Mit freundlichen Grüßen|Viele Grüße|Un saludo|Atentamente],\\n{N}[\\n{R}|]
[Approved|Reviewed|Signed|Written|Owned|Reported|Requested|Maintained|Touched|Rejected|Closed] by {N}[, who {W}| {w}|, {R}|].
[Reviewer|Owner|Author|Editor|Approver|Witness|Manager|Engineer|Steward] {N} [rejected|accepted|read|signed|closed] {W}
[Owner|Name|Contact person|Responsible|Assignee|Verantwortlich|Ansprechpartner|Responsable|Attn]: {N}
[Mr|Mrs|Ms|Miss|Dr.|Mr.|Mrs.|Prof.|Professor|Sir|Doctor] {S} [owns|runs|keeps|answered|signed|said|called|opened] {W}
[Mr|Ms|Dr.|Mrs] {S} [and|or] [Mr|Ms|Dr.|Mrs] {S} [share|split|own|run] {W}
[Mr|Ms|Mrs] {S} [runs|keeps] {c}, [Mr|Ms] {S} [runs|keeps] {W}
[Frau|Herr|Herrn|Dr.|Prof.] {S} [ist|war|hat|wird|bleibt] {W:de}
[Frau|Herr] {S} [ist erreichbar|antwortet|meldet sich|wohnt] [unter|über|auf] {P}{x}.
[La señora|El señor|Don|Doña|El doctor|La doctora|Sr.|Sra.] {S} [reside en|se mudó a|trabaja en] {A}.
[La señora|El señor|Sr.|Sra.|Don] {S} [dice|tiene|lleva|abrió] {W:es}
{N} [vive|reside|trabaja] en {A}.
{N} wohnt [in der|in|jetzt in der] {A}.
[Anschrift|Adresse|Postanschrift|Lieferadresse][ des Kunden| der Firma|]: {A}
[Dirección|Domicilio|Enviar a]: {A}
[Address|Ship to|Deliver to|Billing address|Home|Return to|Site]: {A}
[I|We|They|She|He] [live at|moved to|lives at|stayed at|work at] {A}[.| since {year}.| {w}.]
[Send|Ship|Deliver|Post|Bring] [it|the box|the parcel|the spare part|the badge] to {A}[.|, attention {N}.|, care of {N}.]
The [visit|meeting|delivery|inspection] [by {N} |]at {A} [on {date}|is {w}|at {hm}|was called off].
[Relocated|Moved|The move] from {A} to {A}[ in {year}|].
{N}\\n{A}
{N}, {A}, {P}
[The letter|It|This|The box|Der Brief|Das Paket|La carta] [went to|is for|ging an|ist für|es para|llegó a] {N}, {A}.
[Person|Applicant|Citizen|Claimant|Subject|Patient|Employee|Holder|Insured] {I}: {W}
{W} {I}: {W}
{N} [and|or|und|y] {N} {W}
"{W}" [said|wrote|asked] {N} {w}
"{W}"; [ask|tell|see|write to] {N} [instead|too|again].
{N};{A};{P};{E};{I}
{N}\\t{P}\\t{E}
| {N} | {P} | {I} |
| {E} | {N} | {n4} |
{"[name|owner|author|user|person]":"{N}","[mail|email|contact]":"{E}","[job|kind|part]":"{c}"}
{"[phone|tel]": "{P}", "[address|addr]": "{A}", "id": {n4}}
[name|user|owner]={N} [mail|email]={E} [phone|tel]={P}
[The contract|The form|The file|Row {n2}|This record|Fixture] [lists|names|holds|shows|contains] {N}, {I}[, {A}|, {P}|] and {W}
[ID|id|Id] {I} / [phone|tel] {P} / [build|run|rev] {hex}
"{N}" [was|stands] [misspelt|twice|first] in {c}.
[The secret question|The account|The locker] of {N} [reads|shows] "{n4}".
[Escalate|Escalations|Complaints|Questions] [for {c} |]go to {N} ({E}) {w}.
[Bei Fragen|Rückfragen|Rückfragen bitte] [an|bei] {N}, [Tel.|Telefon] {P}{x}.
{W} {N} {W}
{W} {Q}{x} {W}
[number|phone|call|ring|tel|mobile|line|dial|fax|text] {P}{x} {W}
{W} [number|phone|at|call|ring|tel|mobile|line] {P}{x}
{W} [issued|registered|filed|listed|known|insured|entered|booked] [under|as|with] {I}[; {W}|, {W}|.]
The {L} of the {L} [is|was|stays] [issued|registered|listed|kept|held] [under|as] {I}[; {W}|.]
{W} [by|with|from|to|for|about|near] {N} [at|in|on] {A} {W}
{N} {V} that {c} {W}
{N} {V} [whether|why|how|when] {W}
[I|We|They|She] [asked|met|saw|told|thanked|phoned] {N}, [they|she|he|and they|who] [said|say|knew|think] {W}
{c} [is|was] {V} by {N} {w}, [who|which] {W}
{c} [ships|goes|moves] to {A}, [attention|attn|care of|c/o] {N}.
[tel.|phone|tel|mobile|Telefon|teléfono] {P}{x}, {W}
[Taxpayer|Tax|Citizen|Passport|Social security|Insurance|Identity|Personal] [no|no.|number|ID|id|#] {I} {W}
[Steuernummer|Ausweis|Pasaporte|DNI|NIE|SSN] [Nr.|n.º|no.|] {I} {W}
{W} {E} {W}
{W} {A}, {W}
{W:de} {N} {W:de}
{W:es} {N} {W:es}
{N}: {W}
{W}: {N}
[on-call|On call|Standby|Backup]: {N}, [tel.|phone|mobile] {P}{x}[, backup mail {E}|, mail {E}|]
{N} [last|first|also] [touched|edited|changed|built] {c} {w}[, and {W}|].
[he|she|they] asked {N}[, they said| who said] {W}
The [fee|invoice] for {N} of {A} is {n3} [euros|dollars].
[fax|number] {P}, [e-mail|mail] {E}, [home|street] {A}
"""
NEG = """
{D} {n3}-{n2}-{n4}[x|a|] [was|is|got] [rebuilt|renamed|moved|shipped|closed|lost|split|opened] {W}
{D} [no. |number |#|]{n3}-{n2}-{n4} [of|for|in] {c} {W}
The code {n3}-{n2}-{n4}[x|b] [opens|marks|names] {W}
{D} {n4}-{n2}-{n4} [was paid|is due|is overdue|was sent] {w}.
[Shelf|Seat|Locker|Platform|Disk] {n3}-{n4} [holds|stays|keeps] {W}
[lib|doc|app|pkg]/{c}/[main|util|core].[py|go|md|js]:{n3}-{n4} [repeats|holds|lacks] {W}
[Sizes|Limits|Steps] {n2}/{n2}/{n2} [gave|left|cost] {n3} {n3} {n4} {U} {w}.
[Decision|Rule|Note|Version|Chapter] {n2}: {c} {W}; [replaces|supersedes|extends] {n2}.
[Hash|Digest|Commit|Object] {hex} [equals|follows|replaces] {hex}, {n4}..{n6}.
[Address|Pointer|Block] 0x{hex} [in|of] {c} is [read|freed|mapped] {w}.
[Server|Node|Peer|Router] 172.{n2}.{n1}.{n2} [lost|refused|dropped] [packets|calls] [on|at|@] [port|socket] {n4}.
[Host|Gateway] 192.168.{n1}.{n2}:{n4} {W}
{D} {n2}.{n2}.{n2}.{n2} [released|published|shipped] {date}.
The {c} {W}
{c}: {W}
[Passport|License|Ticket|Number|Address|Phone|Email|Name] [fields|rules|checks|validation|format][:| is|] {W}
The {ST} [service|project|release|module|team|queue] {W}
[Plot|Sort|Rank|Take] {n2} {T} [items|values]; {n3} [Place|Grove|Walk|Lane|Road|Close] {U} are left.
{n2} [Lanes|Hills|Groves|Drives|Courts|Roads] {W}, [chapter|part] {n3}.
{n2} {U} [in|of] {T} and {n3} [Street|Lane|Court] {U} {W}
[El|La|Un] {c} {W:es}
[Der|Die|Das] {c} {W:de}
{W:de}.
{W:es}.
{W}.
{W}
{W}, {W}.
[Run|Job|Deploy] {n4}-{n3}-{n4} [stopped|passed|hung] [with|at] [status|step] {n1}[, counter {n10}|].
[Phone|Mail|Call|Text] [support|search|export] [came|ends|runs] with [build|version] {n8}.
[note|fyi|todo|later|idea]: [will|hope|grace|may|rose|joy|bill|art|frank|mark|summer|dean] {W} [rose|mark|may|hope|will|grant|chase|summer|april] {W}
[Mark|Will|May|Hope|Grace|Bill|Art|Frank] the [date|line|spot|file] {w}.
[We call|They call|Everyone calls] [our|the two|these] {c} [jobs|tests|threads|machines] [Mr|Ms|Mrs|Dr.|Miss] {Nick} and [Mr|Ms|Mrs|Dr.] {Nick}.
[Mr|Mrs|Ms|Dr.] {Nick} and [Mr|Ms|Mrs] {Nick} [are|were] [only|just|merely] [aliases|code names|nicknames] [inside|in|of] {c}.
[Mr|Ms|Dr.|Doctor|Professor] {Nick} is [a nickname|our alias|what they call|the pet name] [of|for|] {c}[ and no human|].
{T} and {T} [are|were] [products|modules|programs|releases], not people.
{T} {n2}.{n1} {W}
[We use|Try|Install|See|Open|Close|Update] {T} {w}.
{ORG} [bought|sued|audits|supplies|hired] {W}
{PL} [hosted|signed|banned|won] {W}
{W} in {PL} {w}.
[{PL}|{ORG}] and [{PL}|{ORG}] {W}
[Best|Thanks|Cheers|Hi|Hello|Dear|Hallo|Hola], {G}[.|,|!]
{G} [said|wrote|asked|knows|thinks] {W}
[The|Our] {R} {W}
[Kind regards|Best],\\n{R}
[Type|Sort|Kind|State|Class|Topic|Result|Sent|Goes|Belongs|Level|Store] [of note|to|of entry|now|]: {L}
{Y}: {L}
[Signed-off-by|Reviewed-by|From|Owner|Author|Approved-by]: {c} [<none>|<>|(bot)|]
{c}: {L} {L} [are|were|is] [kept|dropped|moved|read] {W}
[then|about|only|nearly|with|of] {n3} {n3} {n4} {U} {W}
{W} {n3} {n3} {n4} {U}
{W} {n3} {n4} {U}, {n2} {n3} {n3} {U}
The {B} [of {PL} |]{W}
{Y} {L} [is|was|are|at|of|to] {M}, [then|and|next|or] {W}
{Y} {L} [is|was|are|at|of|to|stays] {M}, [then|and|next|or] {n3} {n3} {n4} {L} {W}
[hash|sha|digest|key|object|commit] {n12} [spans|holds|has|marks] {W}
{W} #{n4}; {T} [is|was|ends|stays] [at|above|below|near] {n2} {U}.
{T} {V} {W}
{W}; {T} [is|has|needs|shows] {W}
{W}[;|,] [counter|index|sequence|position|offset|entry|cursor] [00|000|]{n8}
{W} [code|status|step|level] {n1}[;|,] {L} 00{n8}[.|]
{L}@{n1}.{n2}.{n1} [is|was] {W}
{Y} {M} [failed|passed|is|was|ran|stopped|moved] {W}
[{D}|{Y}|{c}] {M} {L} {W}
{W} {M} {L}.
{L} {M}: {W}
[{Y}|{W}] {n3} {n3} {n4} {L}[s|] {W}
{W} the {B} {W}
{B}: {W}
"{c} {W}" [and|or] "{L} {L}"
{W:de} {Y:de} {W:de}
{W:de} nach jeder {Y:de}.
{G} and {G} {W}
git@{word}.example:{word}/{c}.git [was cloned|is the remote|moved]
[Fetch|Pull|Push] [to|from] git@[code|git].{word}.[example|com|org]:{word}/{c}.git {w}.
[pin|use|install] {word}@{n1}.{n1}.{n2}[ and {word}@{n2}.{n1}|]
[@{word}-bot|@{word}|@{c}] [closed|opened|labelled] #{n4}, {W}
[root|bot|svc|admin]@{hex} [opened|closed|lost] the session {w}.
[user|deploy]@{c} [logged in|left] at {hm}.
{c} [was reset|changed|went up] on {date} {hm}.
[Key|Object] {hex}-{n4}-{n4} [follows|copies] {hex}.
[Ratio|Score|Range|Odds] {n2}:{n2}, {n3}-{n3}, {n1}.{n4}
{D} {n3}-{n2}-{n2} {W} [+|-]0{n1}:00
[{date}|{date}T{hm}:{n2}Z|{date} {hm}] {W}
[ref|see|tracking|order] [QLM|ABC|KX|TCK|INV]-{n3}-{n3}-{n4}
[Total|Sum|Count]: {n3} {n3} {n3} {U}, {n2},{n3},{n3} {U}
{n10} [is|was] [a|the] [timestamp|cursor|counter|checksum].
[ISBN|EAN|DOI|IBAN test] {n3}-{n1}-{n4}-{n4}-{n1}
v{n1}.{n1}.{n2}-rc{n1} {W}
[{c}|{T}] [owner|author|reviewer|contact] [said|must|may]: {W}
"{W}" [was|is] the [question|answer|title].
| {c} | {n4} | {hex} |
{"kind":"[note|claim|task]","part":"{c}","n":{n4}}
[kind|status|type|Label|Queue]: [none|open|closed|urgent|private]
[Answer|Choose|Tick] [yes|no] [if|when] {W}; {W}
[the|a] [street|road|lane|house] {W}
{n2} [Main|Church|Oak|Summer] [tests|items|rows|files] {W}
[address|name|phone|email] is [required|optional|missing|empty] in {c}
"""


@cache
def _forms(which: str) -> list[str]:
    return [x.replace("\\n", "\n").replace("\\t", "\t") for x in {"pos": POS, "neg": NEG}[which].strip().splitlines()]


@cache
def vocabulary(lang: str) -> list[str]:
    """Whole words of three letters and more: lower-case English ones, or those of other languages in Latin letters."""
    read = lambda f: {base64.b64decode(x.split()[0]).decode("utf-8", "ignore") for x in (TOKENIZERS / f).read_bytes().splitlines()}
    english = {t[1:] for t in read("byte_bpe_50k.tiktoken") if re.fullmatch(r" [a-z]{3,14}", t)}
    if lang == "en":
        return sorted(english)
    return sorted({t[1:] for t in read("byte_bpe_multi_50k.tiktoken") if re.fullmatch(r" [a-záéíóúñüäöß]{4,14}", t)} - english)


_CHOICE = re.compile(r"\[([^\[\]]*\|[^\[\]]*)\]")
_SLOT = re.compile(r"\{(\w+(?::\w+)?)\}")


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, xs: list[str]) -> str:
        return self.r.choice(xs).replace("_", " ")

    def word(self) -> str:
        return "".join(self.r.choice(SYL) for _ in range(self.r.randint(1, 3)))

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def hexes(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))

    def invented(self) -> str:
        return (self.word() + self.r.choice(ENDING)).capitalize()

    def given(self) -> str:
        r = self.r
        g = r.choice(GIVEN) if r.random() < 0.7 else self.word().capitalize() if r.random() < 0.6 else self.invented()
        return f"{g}-{r.choice(GIVEN)}" if r.random() < 0.04 else g

    def family(self) -> str:
        x = self.r.random()
        s = self.r.choice(FAMILY) if x < 0.42 else self.invented() if x < 0.86 else (self.word() + self.word()).capitalize()
        y = self.r.random()
        return "O'" + s if y < 0.07 else self.r.choice(["Mc", "Mac", "D'", "St. "]) + s if y < 0.1 else s

    def surname(self) -> str:
        s = self.family()
        if self.r.random() < 0.08:
            s += self.r.choice(["-", "-", " "]) + self.family().replace("St. ", "")
        return f"{self.pick(PARTICLE)} {s}" if self.r.random() < 0.22 else s

    def cased(self, s: str) -> str:
        x = self.r.random()
        return s.lower() if x < 0.1 else s.upper() if x < 0.17 else s

    def initial(self) -> str:
        return self.r.choice("ABCDEFGHIJKLMNOPRSTUVWYZ") + self.r.choice([".", ".", ".", ". "]).strip()

    def name(self) -> str:
        x = self.r.random()
        g, s = self.given(), self.surname()
        if x < 0.55:
            n = f"{g} {s}"
        elif x < 0.66:
            n = f"{g} {self.initial()} {s}"
        elif x < 0.76:
            n = f"{self.initial()} {s}"
        elif x < 0.8:
            n = f"{self.initial()}{self.r.choice([' ', ''])}{self.initial()} {s}"
        elif x < 0.85:
            n = f"{g} {self.given()} {s}"
        else:
            n = f"{s}, {g}" + (f" {self.initial()}" if self.r.random() < 0.15 else "")
        return self.cased(n)

    def titled(self) -> str:
        """What may follow a title: a surname alone, or a whole name."""
        return self.cased(self.surname()) if self.r.random() < 0.65 else self.name()

    def groups(self, sizes: list[int], joint: str) -> str:
        return joint.join(self.d(n) for n in sizes)

    def phone(self) -> str:
        r, d = self.r, self.d
        x = r.random()
        if x < 0.3:  # North America
            j = r.choice(["-", "-", " ", "."])
            a = d(3) if r.random() < 0.7 else "555"
            body = r.choice([f"({a}) {d(3)}{r.choice(['-', ' '])}{d(4)}", f"{a}{j}{d(3)}{j}{d(4)}", f"({a}){d(3)}-{d(4)}"])
            return r.choice(["", "", "", "+1 ", "1-", "+1-"]) + body
        if x < 0.65:  # international
            cc = r.choice(["1", "7", "20", "27", "31", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "86", "91", "351", "353", "420"])
            j = r.choice([" ", " ", " ", "-", ".", ""])
            lead = r.choice(["+", "+", "+", "00"])
            zero = "(0)" if r.random() < 0.08 and j == " " else ""
            return f"{lead}{cc}{j or r.choice(['', ' '])}{zero}{self.groups(r.choice([[1, 2, 2, 2, 2], [2, 4, 4], [3, 3, 3], [3, 2, 2, 2], [2, 5, 3], [4, 6], [3, 3, 4], [1, 4, 4], [2, 8], [9], [2, 7], [4, 3, 3], [3, 4, 4]]), j)}"
        j = r.choice([" ", " ", "-", ".", "/"])
        body = r.choice([lambda: f"0{self.groups([2, 2, 2, 2], j)[:0]}{d(1)}{j}{self.groups([2, 2, 2, 2], j)}", lambda: f"0{d(2)}{r.choice(['/', '-', ' '])}{d(r.randint(4, 5))}{r.choice([' ', '-', ''])}{d(3)}", lambda: f"0{d(4)} {d(6)}", lambda: f"0{d(10)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"{r.choice('6789')}{d(2)} {self.groups([2, 2, 2], ' ')}", lambda: f"{r.choice('6789')}{d(2)} {d(3)} {d(3)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"(0{d(r.randint(2, 4))}) {d(r.randint(5, 7))}"])
        return body()

    def sure_phone(self) -> str:
        """One that its form alone gives away."""
        while (p := self.phone())[0] not in "+(0":
            pass
        return p

    def number(self) -> str:
        """Groups of digits as budgets, dates, builds, ratios and sizes have them."""
        r = self.r
        sizes = r.choice([[2, 2, 2], [2, 2, 2], [4, 3, 4], [4, 2, 4], [3, 2, 2], [2, 2, 4], [3, 3, 4], [3, 3, 3], [1, 3, 3], [3, 4], [2, 3], [3, 3], [4, 4], [4, 4, 4], [1, 2, 1], [10], [8], [6], [5, 5]])
        return self.groups(sizes, r.choice("//--..  :x,"))

    def ident(self) -> str:
        d, r = self.d, self.r
        u = lambda n=1: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
        j = r.choice(["-", "-", " "])
        return r.choice([lambda: f"{d(3)}{j}{d(2)}{j}{d(4)}", lambda: f"{d(3)}{j}{d(2)}{j}{d(4)}", lambda: f"{d(8)}{r.choice(['', '', '-', ' '])}{u()}", lambda: f"{r.choice('XYZ')}{r.choice(['', '-'])}{d(7)}{r.choice(['', '-'])}{u()}", lambda: f"{u(2)} {d(2)} {d(2)} {d(2)} {u()}", lambda: f"{u(2)}{d(6)}{u()}", lambda: f"{u(2)}{d(7)}", lambda: f"{u()}{d(8)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"{d(5)} {d(3)} {d(3)}", lambda: f"{d(11)}", lambda: f"{d(9)}", lambda: f"{u(1)}{d(2)}{u(1)}{d(5)}{u(1)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"{u()}{d(3)}-{d(4)}-{d(4)}", lambda: f"{d(6)}-{d(4)}", lambda: f"{u(5)}{d(6)}{u(2)}"])()

    def email(self) -> str:
        r = self.r
        plain = lambda s: re.sub(r"[^a-z-]", "", s.lower())
        f, s = plain(self.given()) or "x", plain(self.family()) or "y"
        box = r.choice([lambda: f"{f}.{s}", lambda: f"{s}{r.choice('_-.')}{f}", lambda: f"{f}+{self.word()}{self.d(2)}", lambda: f"{s}{self.d(2)}", lambda: f"{f[0]}{s}", lambda: f"{f}-{s[:3]}", lambda: s, lambda: f, lambda: f"{r.choice(['info', 'sales', 'team', 'hr', 'office'])}", lambda: f"{f}{self.d(4)}"])()
        dom = r.choice([lambda: f"{self.word()}{r.choice(['', '-' + r.choice(DOMAIN)])}.{r.choice(TLD)}", lambda: f"{r.choice(DOMAIN)}.{self.word()}.{r.choice(TLD)}", lambda: f"{r.choice(DOMAIN)}{self.d(1)}.{self.word()}.{r.choice(TLD)}", lambda: f"{r.choice('öäüéñ')}{self.word()}.{r.choice(TLD)}"])()
        x = r.random()
        dot = lambda a, b: dom.replace(".", f" {a}dot{b} ")
        e = f"{box}@{dom}" if x < 0.62 else f"{box}＠{dom}" if x < 0.69 else f"{box}{r.choice([' (at) ', '(at)', ' [at] ', '[at]'])}{dom}" if x < 0.8 else f"{box} {r.choice(['[at]', '(at)'])} {dot(*r.choice(['[]', '()']))}" if x < 0.9 else f"{box} at {dot('', '')}"
        return e.upper() if r.random() < 0.08 else e

    def address(self) -> str:
        r, d, x = self.r, self.d, self.r.random()
        own = lambda: (self.word() + r.choice(["", "", "gate", "hill", "brook", "field", "bridge", "well", "ton", "wood"])).capitalize()
        if x < 0.6:
            no = str(r.randint(1, 9999 if r.random() < 0.2 else 260)) + (r.choice("ABCabc") if r.random() < 0.08 else "")
            st = self.pick(STREET_EN) if r.random() < 0.5 else own() + (f" {own()}" if r.random() < 0.2 else "")
            a = f"{no} {st} {r.choice(WAY)}"
            y = r.random()
            if y < 0.12:
                a = f"{r.choice(['Flat', 'Apt', 'Unit', 'Apartment', 'Suite'])} {r.randint(1, 90)}, {a}"
            elif y < 0.18:
                a += r.choice([f", Apt {d(1)}{r.choice('ABCD')}", f" Apt. {d(2)}", f" #{d(2)}", f", Suite {d(3)}", " NW", " SE"])
            if r.random() < 0.68:
                town = self.pick(TOWN_EN) if r.random() < 0.45 else r.choice(["", "", "East ", "Port ", "Upper ", "New ", "Great "]) + own() + r.choice(["", "", "", "-on-Sea", " Green"])
                us = f"{r.choice(['CA', 'NY', 'TX', 'IL', 'OR', 'MA', 'WA', 'CO'])} {d(5)}"
                uk = f"{''.join(r.choice('ABCDEGHLMNPQRSWX') for _ in range(r.randint(1, 2)))}{r.randint(1, 29)} {d(1)}{''.join(r.choice('ABDEFGHJLNPQRSTUWXYZ') for _ in range(2))}"
                code = us if r.random() < 0.35 else uk
                sep = "\n" if r.random() < 0.3 else ", "
                dot = "." if a[-1:].isalpha() and a.split()[-1] in ("St", "Ave", "Rd", "Dr", "Ln", "Ct", "Blvd") and r.random() < 0.4 else ""
                a += dot + r.choice([f"{sep}{town}{' ' if sep == ', ' else sep}{code}", f"{sep}{town}, {code}", f"{sep}{town} {code}", f"{sep}{town}"])
        elif x < 0.8:
            st = r.choice([lambda: self.pick(STREET_DE) + r.choice(WAY_DE), lambda: own() + r.choice(WAY_DE), lambda: self.pick(STREET_DE2), lambda: f"Am {own()}"])()
            a = f"{st} {r.randint(1, 240)}{r.choice(['', '', '', 'a', ' b', '-' + d(1)])}"
            if r.random() < 0.75:
                a += r.choice([", ", ", ", "\n"]) + f"{r.choice(['', '', 'D-'])}{d(5)} {self.pick(TOWN_DE) if r.random() < 0.5 else own() + r.choice(['', 'burg', 'feld', 'dorf'])}"
        else:
            st = f"{self.pick(WAY_ES)} {self.pick(STREET_ES) if r.random() < 0.5 else r.choice(['', 'de ', 'del ']) + own()}"
            a = f"{st}{r.choice([' ', ' ', ', ', ' n.º '])}{r.randint(1, 200)}"
            if r.random() < 0.6:
                a += r.choice([f", {r.randint(1, 9)}º {r.choice('ABCD')}", f", {r.randint(1, 9)}.º {r.choice(['izq', 'dcha', 'A'])}", f", piso {d(1)}"])
            if r.random() < 0.75:
                a += r.choice([", ", ", ", "\n"]) + f"{d(5)} {self.pick(TOWN_ES) if r.random() < 0.5 else r.choice(['', 'Santa ', 'Puerto ', 'Villa ']) + own()}"
        return a.lower() if r.random() < 0.02 else a.upper() if r.random() < 0.01 else a

    def ext(self) -> str:
        return self.r.choice([" (ext. " + self.d(2) + ")", " ext. " + self.d(3), " x" + self.d(2), " (ext. " + self.d(3) + ")", ", ext. " + self.d(2), " Durchwahl " + self.d(2)]) if self.r.random() < 0.14 else ""

    def words(self, lang: str) -> str:
        r, ws = self.r, WORDS[lang]
        out = []
        for _ in range(r.randint(1, 9)):
            x = r.random()
            out.append(r.choice(ws) if x < 0.4 else self.loose(lang) if x < 0.8 else f"{r.choice(vocabulary('en'))}-{r.choice(vocabulary('en'))}" if x < 0.82 else r.choice(ws) if x < 0.84 else self.comp() if x < 0.9 else r.choice(TECH) + r.choice(["s", ""]) if x < 0.95 else self.word() if x < 0.97 else str(r.randint(1, 999)))
        return " ".join(out)

    def loose(self, lang: str) -> str:
        w = self.r.choice(vocabulary("en" if lang == "en" else "other"))
        return w.capitalize() if lang == "de" and self.r.random() < 0.4 else w

    def comp(self) -> str:
        r = self.r
        if r.random() < 0.3:
            return f"{r.choice(vocabulary('en'))}-{r.choice(vocabulary('en'))}"
        return f"{r.choice(PRE)}-{r.choice(TECH)}" if r.random() < 0.6 else f"{self.word()}-{r.choice(TECH)}" if r.random() < 0.6 else f"{r.choice(TECH)}-{r.choice(TECH)}"

    def slot(self, k: str) -> tuple[str, int]:
        r = self.r
        details = {"Q": (self.sure_phone, 1), "N": (self.name, 4), "S": (self.titled, 4), "A": (self.address, 3), "P": (self.phone, 1), "E": (self.email, 0), "I": (self.ident, 2)}
        if k in details:
            make, kind = details[k]
            return make(), kind
        if k[0] == "n" and k[1:].isdigit():
            return self.d(int(k[1:]) if r.random() < 0.75 else max(1, int(k[1:]) + r.choice([-1, 1]))), -1
        if k == "Y:de":
            return r.choice(vocabulary("other")).capitalize(), -1
        if k[0] == "W":
            return self.words(k[2:] or ("en" if r.random() < 0.9 else r.choice(["de", "es"]))), -1
        return {
            "x": self.ext, "c": self.comp, "w": lambda: r.choice(["at night", "in spring", "by default", "on Mondays", "after lunch", "every week", "during tests", "at startup", "before noon", "when idle", "this year", "once a day", "after the merge", "for now"]), "G": self.given,
            "date": lambda: r.choice([f"{r.randint(1990, 2030)}-{self.d(2)}-{self.d(2)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1990, 2030)}"]), "year": lambda: str(r.randint(1950, 2035)), "hm": lambda: f"{self.d(2)}:{self.d(2)}",
            "hex": lambda: self.hexes(r.choice([8, 12, 12, 16, 20, 40])), "T": lambda: f"{r.choice(THING) if r.random() < 0.7 else self.word().capitalize()} {self.pick(THING2)}", "ST": lambda: f"{self.pick(STREET_EN) if r.random() < 0.6 else self.word().capitalize()} {r.choice(WAY)}".replace("Dr. ", ""), "word": self.word, "U": lambda: r.choice(UNIT), "D": lambda: r.choice(DEVICE),
            "Nick": lambda: (r.choice(TECH) if r.random() < 0.6 else r.choice("byte bug token shard fix lock crash debug merge patch loop null retry batch cursor timeout cloud pixel".split())).capitalize(), "PL": lambda: self.pick(PLACE), "R": lambda: self.pick(ROLE), "V": lambda: r.choice("said wrote ruled claimed insisted noted hoped feared decided denied proved showed repeated reported argued guessed agreed promised warned checked touched edited built tested found shipped signed".split()), "M": self.number, "L": lambda: r.choice(vocabulary("en")), "Y": lambda: r.choice(vocabulary("en")).capitalize(), "B": lambda: f"{r.choice(BODY)} {r.choice(BODY2)}",
            "ORG": lambda: f"{self.invented() if r.random() < 0.5 else r.choice(FAMILY)} {r.choice(ORG[:3] + ORG[4:9])}" if r.random() < 0.6 else f"{r.choice(FAMILY)} & {r.choice(FAMILY + ['Sons', 'Partners'])}" if r.random() < 0.5 else f"{self.pick(PLACE)} {r.choice(ORG[-4:])}",
        }[k](), -1

    def sentence(self) -> tuple[str, list[tuple[int, int, int]]]:
        form = self.r.choice(_forms("pos") if self.r.random() < 0.6 else _forms("neg"))
        while m := _CHOICE.search(form):
            form = form[: m.start()] + self.r.choice(m[1].split("|")) + form[m.end() :]
        text, spans = "", []
        for i, part in enumerate(_SLOT.split(form)):
            if i % 2 == 0:
                text += part
                continue
            s, kind = self.slot(part)
            if part[0] == "W" and (not text or text.endswith("\n")) and self.r.random() < 0.7:
                s = s[:1].upper() + s[1:]
            if kind >= 0:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s
        if text[-1:].isalnum() and self.r.random() < 0.5:
            text += self.r.choice([".", ".", ".", "!", "?", ";"])
        if self.r.random() < 0.04:  # spelling: two letters outside of details change places
            i = self.r.randrange(max(1, len(text) - 1))
            if all(not a - 1 <= i <= b for _, a, b in spans) and text[i : i + 2].isalpha():
                text = text[:i] + text[i + 1] + text[i] + text[i + 2 :]
        return text, spans

    def text(self) -> tuple[str, list[tuple[int, int, int]]]:
        text, spans = "", []
        for i in range(self.r.choice([1, 1, 1, 2, 2, 3])):
            if i:
                text += self.r.choice([" ", " ", " ", "\n", "\n\n", " – ", " "]) if text[-1:] in ".!?" else self.r.choice(["\n\n", ". ", "; ", " / "])
            s, sp = self.sentence()
            spans += [(k, a + len(text), b + len(text)) for k, a, b in sp]
            text += s
        for _ in range(self.r.choice([0, 0, 0, 0, 0, 1, 2])):  # lines of labels
            label = " ".join([self.r.choice(vocabulary("en")).capitalize(), *(self.r.choice(vocabulary("en")) for _ in range(self.r.choice([0, 0, 1, 2])))])
            text += f"\n{label}: {self.r.choice([self.r.choice(vocabulary('en')), self.words('en')])}"
        return text, spans

    def batch(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = []
        while len(rows) < n:
            text, spans = self.text()
            ids, lab = encode(text), np.zeros(len(text), np.int64)
            for k, a, b in spans:
                lab[a] = 1 + 2 * k
                lab[a + 1 : b] = 2 + 2 * k
            rows += [(ids[a:b], lab[a:b]) for a, b in segments(text) if b - a <= 240]
        rows = rows[:n]
        lengths = np.array([len(i) for i, _ in rows])
        ids, lab = np.full((lengths.max(), n), PAD, np.int64), np.zeros((lengths.max(), n), np.int64)
        for j, (i, x) in enumerate(rows):
            ids[: len(i), j], lab[: len(x), j] = i, x
        return ids, lab, lengths


def _worker(seed: int, conn) -> None:
    m = Maker(seed)
    while (p := conn.recv()) is not None:
        conn.send(loss_and_grad(p, *m.batch(BATCH)))


def score(model: Model, texts: list[tuple[str, list[tuple[int, int, int]]]]) -> dict[str, tuple[float, float]]:
    """Precision and recall of whole spans, by kind, of the model alone."""
    hit, got, want = np.zeros(5), np.zeros(5), np.zeros(5)
    segs, golds = [], []
    for text, spans in texts:
        ids = encode(text)
        for a, b in segments(text):
            segs.append(ids[a:b])
            golds.append({(k, s - a, e - a) for k, s, e in spans if a <= s < b})
    for g, spans in zip(golds, model.decode(segs)):
        for s in spans:
            got[s[0]] += 1
            hit[s[0]] += s in g
        for s in g:
            want[s[0]] += 1
    return {k: (round(hit[i] / max(got[i], 1), 4), round(hit[i] / max(want[i], 1), 4)) for i, k in enumerate(KINDS)}


def evaluate(model: Model, n: int, seed: int) -> dict[str, tuple[float, float]]:
    """``score`` on rule-made texts that were not trained on."""
    m = Maker(seed)
    return score(model, [m.text() for _ in range(n)])


def main(minutes: float, more: bool = False, workers: int = 8) -> None:
    ctx = mp.get_context("fork")
    model = Model.load(OUT) if more else Model.new(HIDDEN, SEED)
    pipes = []
    for i in range(workers):
        a, b = ctx.Pipe()
        ctx.Process(target=_worker, args=(1000 + i + 1300 * more, b), daemon=True).start()
        pipes.append(a)
    p = model.p
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    began, step, mean = time.time(), 0, 0.0
    while (passed := (time.time() - began) / 60) < minutes:
        for c in pipes:
            c.send(p)
        got = [c.recv() for c in pipes]
        loss = float(np.mean([x for x, _ in got]))
        g = {k: np.mean([x[k] for _, x in got], 0) for k in p}
        norm = float(np.sqrt(sum((v * v).sum() for v in g.values())))
        clip = min(1.0, 0.5 / (norm + 1e-9))
        step += 1
        rate = (0.0025 if more else 0.006) * min(1, step / 50) * max(0.02, 1 - passed / minutes)
        for k in p:
            x = g[k] * clip
            m1[k] = 0.9 * m1[k] + 0.1 * x
            m2[k] = 0.999 * m2[k] + 0.001 * x * x
            p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        mean = loss if step == 1 else 0.98 * mean + 0.02 * loss
        if step % 200 == 0:
            print(f"step {step}, {passed:.1f} min, loss {mean:.5f}", flush=True)
    for c in pipes:
        c.send(None)
    model.save(OUT)
    print("held out:", evaluate(Model.load(OUT), 3000, 5), flush=True)


if __name__ == "__main__":
    main(float(sys.argv[1]), "more" in sys.argv)
