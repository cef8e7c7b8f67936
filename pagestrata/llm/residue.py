"""Problem 2: records that hold template residue, filler, errors or demands for scripts in place of content.

Normalised lines are counted by host and language, each address once, and what recurs is subtracted as boilerplate: the
wrappers of ``wrappers`` take out the furniture, and a line of evidence is boilerplate itself if it stands on as large a share of its
host's pages as other template texts and on most of these beside a passage (a notice on every page; the message that fills
failing pages stands beside none). A plain text has no host and is its own residual. Each sentence of the residual is then
judged: it is evidence if it has unfilled slots or printed empty values about which little else
is said, filler, or is a message: a fixed phrase, or a short sentence that names both sides of a pair of concepts (a page, server or
file, and that it is missing, moved or down; scripts, and that they are needed; access or a session, and that it is denied or over).
A record is residue if its residual has evidence and next to no words outside it; a real passage, whatever it quotes, leaves more.

Defined cases: null or empty texts, and pages whose markup leaves no residual at all, are no residue; repeated rows
count once; extra columns are ignored; a payload that is no JSON gives nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestrata.functions.html import squeezed
from pagestrata.llm import wrappers
from pagestrata.llm.words import HAN, nfc, words
from pagestrata.session import written

#: Words that may stand beside the evidence: a name, a number, a heading's rest.
SPARE = 6

#: Words that a message may have, names apart; Han characters count one each.
MESSAGE, MESSAGE_HAN = 14, 24

_SLOT = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|&lt;%.*?%&gt;|%%[^%\s][^%]*?%%|@@[^@\s][^@]*?@@|\[\[.*?\]\]|\$\{.*?\}|(?<![\w#])#[A-Za-z_][^#\n]*#|__[A-Za-z][^\n_]*(?:_[^\n_]+)*__(?!\w)|\{[A-Za-z_][^{}\n]*\}|\[[A-Za-z_][^\[\]\n]*\]"
    r"|\[object Object\]|\b(?:undefined|NaN|null|None)\b"
)
# fixed values: the standard filler text's words
FILLER = frozenset(
    "aliquam amet augue blandit commodo congue consectetur cursus dapibus diam dictum dolor donec eget egestas elit enim erat etiam faucibus felis fusce gravida "
    "hendrerit iaculis ipsum justo lacus laoreet lectus lorem magna massa mattis mauris morbi neque nibh nisl nulla nunc odio orci ornare pede porta pretium purus "
    "quam quisque risus rutrum sapien sed sem sit tellus tempor tincidunt tortor turpis ultrices urna ut varius vehicula vel velit vestibulum vitae vivamus viverra vulputate".split()
)
_NOT_DONE = {
    "filler": r"lorem ipsum|lipsum|(?:place ?holder|dummy|filler|sample) (?:text|copy|paragraph)|your (?:text|copy|content) (?:goes )?here|(?:body )?copy to be supplied|\btodo\b ?:|to be written|"
    r"blindtext|platzhalter|fülltext|hier steht (?:später|bald)|mustertext|faux texte|texte (?:de remplissage|à venir|provisoire)|texto (?:de relleno|provisional|de ejemplo)|aquí va el texto|"
    r"示例文本|占位文(?:字|本)|待替换|(?:正文|内容)稍后补充|\b(?:asdf|qwer)\b",
    "script": r"turn it on in your browser|<noscript",
    "error": r"\b(?:error|erreur|fehler|http)\b ?:? ?[45]\d\d|\b[45]\d\d\b ?(?:[-–—:] ?)?(?:not found|bad gateway|forbidden|unauthori[sz]ed|internal|service|gateway|seite|未找到|错误)|\bnot found\b|does not exist|"
    r"something went wrong|our team has been told|internal server error|traceback|exception in|stack trace|undefined index|can.t be reached|took too long|temporarily unavailable|is gone|not available in your|"
    r"nicht gefunden|konnte nicht geladen|introuvable|momentanément indisponible|no se encuentra|no está disponible|暂时不可用|未找到",
    "refusal": r"access denied|permission to (?:view|access)|too many requests|slow down and retry|prove you are (?:a )?human|are you a robot|sign in again|accès refusé|acceso denegado|没有权限",
    "waiting": r"^loading\b|checking your browser|takes a moment|please (?:wait|try again)|try again (?:later|in)|(?:scheduled |under |down for )maintenance|will be back soon|wartung|bald wieder erreichbar|bitte später|später erneut|veuillez réessayer|réessayer plus tard|"
    r"inténtelo|más tarde\b|maintenance en cours|en mantenimiento|维护中|很快恢复|稍后再试|请稍(?:候|等)|正在加载|if nothing happens",
}
_EVIDENCE = {k: re.compile(v, re.I) for k, v in _NOT_DONE.items()}
# beginnings of words of each concept, in the languages covered
_CONCEPTS = {
    "subject": "page;site;website;url;link;address;server;service;request;connection;content;resource;document;file;article;app;application;host;gateway;seite;webseite;adresse;dienst;verbindung;anfrage;inhalt;datei;anwendung;"
    "serveur;connexion;requête;contenu;fichier;lien;ressource;página;sitio;servidor;servicio;conexión;solicitud;contenido;archivo;enlace;recurso;页面;网页;网站;网址;服务;链接;请求;连接;内容;资源;文件",
    "failed": "not found;be found;not exist;doesn't exist;doesn’t exist;no longer exist;no longer available;not available;unavailable;not be loaded;not be reached;not be displayed;not be completed;failed to load;not respond;took too long;timed out;"
    "refused to connect;is down;are down;offline;has moved;was moved;been moved;been removed;been deleted;nicht gefunden;existiert nicht;nicht mehr verfügbar;nicht verfügbar;nicht erreichbar;nicht geladen;nicht angezeigt;fehlgeschlagen;"
    "antwortet nicht;existe pas;existe plus;introuvable;indisponible;plus disponible;pas disponible;répond pas;a échoué;pas été trouv;no existe;no encontrad;no se encuentra;no se encontr;no disponible;no está disponible;no se pudo;"
    "no responde;ha fallado;不存在;找不到;未找到;无法访问;无法显示;无法加载;不可用;已删除;打不开;没有响应",
    "scripts": "javascript;java script;script;scripting;skript;脚本",
    "needed": "enable;activate;allow;turn on;turned on;turn java;switch on;switched;require;need;block;without;disable;aktivier;einschalt;einzuschalt;benötig;erforderlich;active;activez;activer;activar;habilit;necesit;besoin;requiert;requis;requiere;"
    "désactiv;desactiv;deaktivier;recharg;recarg;启用;开启;需要;打开;允许",
    "access": "access;permission;authoriz;authoris;zugriff;zugang;berechtigung;accès;autorisation;acceso;permiso;访问;权限",
    "denied": "denied;refused;forbidden;not allowed;restricted;not have;don't have;don’t have;verweigert;keine;gesperrt;verboten;refusé;interdit;pas autorisé;avez pas;denegado;prohibido;no tiene;拒绝;禁止;没有;无",
    "session": "session;login;sitzung;anmeldung;sesión;会话;登录",
    "over": "expired;timed out;has ended;abgelaufen;beendet;expiré;terminé;caducado;expirado;过期;超时",
    "down": "service unavailable;bad gateway;gateway timeout;bad request;method not allowed;request timeout;maintenance;mantenimiento;wartungsarbeiten;under construction;维护",
}
#: Kinds of evidence by the concepts that a message names.
_RULES = (("script", {"scripts", "needed"}), ("error", {"subject", "failed"}), ("refusal", {"access", "denied"}), ("refusal", {"session", "over"}), ("error", {"down"}))
_CONCEPT = ahocorasick.Automaton()
for _name, _stems in _CONCEPTS.items():
    for _stem in _stems.split(";"):
        _CONCEPT.add_word(_stem, _CONCEPT.get(_stem, ()) + ((len(_stem), _name),))
_CONCEPT.make_automaton()


def concepts(low: str) -> set[str]:
    """The concepts that a sentence in lower case names; a stem counts at the beginning of a word, Han anywhere."""
    out = set()
    for end, found in _CONCEPT.iter(low):
        for size, name in found:
            start = end - size + 1
            if start == 0 or not low[start - 1].isalpha() or low[start] > "⺀":
                out.add(name)
    return out


_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")
# what a message names: addresses, quoted names, dates, codes
_NAMED = re.compile(r"[\"“«„][^\"”»“\n]*[\"”»“]|https?://\S+|\S*[/@]\S*|\b[\w-]+(?:\.[\w-]+)+\S*|\([^()\n]*\)|\b\w*\d[\w:.-]*")
_HAN = re.compile(f"[{HAN}]")


def kind_of(sentence: str) -> str:
    """What kind of residue a sentence is; empty for none."""
    slots = len(_SLOT.findall(sentence))
    rest = words(_NAMED.sub(" ", _SLOT.sub(" ", sentence)))
    if slots and (not rest or len(rest) <= (12 if _HAN.search(sentence) else 8) * slots and (slots > 1 or len(rest) <= (8 if _HAN.search(sentence) else 7))):
        return "template"
    plain = _SLOT.sub(" ", sentence)
    for k, pattern in _EVIDENCE.items():
        if pattern.search(plain):
            return k
    low = plain.lower()
    got = concepts(low)
    if len(got) > 1 or "down" in got:
        short = len(rest) <= (MESSAGE_HAN if _HAN.search(plain) else MESSAGE)
        for k, named in _RULES:
            if named <= got and (short or k == "script"):
                return k
    latin = [w for w in rest if w in FILLER]
    if len(rest) >= 3 and len(latin) >= 0.6 * len(rest):
        return "filler"
    if len(rest) >= 3 and len(set(rest)) <= 1 + len(rest) // 6:
        return "filler"
    return ""


# no evidence is without one of these; a text is scanned for all of them at once
_TRIGGERS = (
    "{;%;@@;[;#;__;lorem;ipsum;lipsum;holder;dummy;filler;sample;goes here;text here;copy here;content here;be supplied;todo;be written;blindtext;platzhalter;fülltext;steht später;steht bald;muster;"
    "faux texte;texte;texto;示例;占位;待替换;稍后;asdf;qwer;script;skript;脚本;your browser;error;erreur;fehler;http;not found;bad gateway;forbidden;unauthori;internal;gateway;错误;service;seite;not exist;could not;went wrong;"
    "been told;traceback;exception;stack trace;undefined;warning;be reached;too long;unavailable;is gone;not available;gefunden;konnte nicht;introuvable;indisponible;no se encuentra;disponible;未找到;暂时;denied;"
    "permission;too many;slow down;prove you;robot;session;sign in;zugriff;sitzung;accès;acceso;sesión;权限;会话;loading;checking;moment;please;try again;maintenance;back soon;wartung;erreichbar;bitte;später;veuillez;"
    "réessayer;inténtelo;más tarde;mantenimiento;维护;恢复;请稍;正在;if nothing"
).split(";") + [stem for side in ("scripts", "failed", "denied", "over", "down") for stem in _CONCEPTS[side].split(";")]
_SCAN = ahocorasick.Automaton()
for _t in _TRIGGERS:
    _SCAN.add_word(_t, _t)
_SCAN.make_automaton()


def judged(sentence: str) -> int:
    """-1 for evidence, else how many words of other text the sentence has, names and numbers apart."""
    low = sentence.lower()
    if next(_SCAN.iter(low), None) is None and not ("NaN" in sentence or "null" in sentence or "None" in sentence):
        # without a trigger only kind_of's tests of the words are left
        rest = words(_NAMED.sub(" ", sentence))
        if len(rest) < 3 or sum(w in FILLER for w in rest) < 0.6 * len(rest) and len(set(rest)) > 1 + len(rest) // 6:
            return len(rest)
    return -1 if kind_of(sentence) else len(words(_NAMED.sub(" ", sentence)))


def sentences(text: str) -> list[str]:
    return [s for s in (squeezed(x) for x in _SENTENCE.split(nfc(text))) if s]


def is_residue(marks: list[int], spare: int = SPARE) -> bool:
    return any(m < 0 for m in marks) and sum(m for m in marks if m > 0) <= spare


def _of_texts(spare: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kinds = [], []
            for text in batch.column(1).to_pylist():
                got = sentences(text)
                marks, left = [], 0
                for s in got:  # a passage ends the search: what follows cannot bring its words down
                    marks.append(judged(s))
                    left += max(0, marks[-1])
                    if left > spare:
                        break
                hit = left <= spare and is_residue(marks, spare)
                out.append(hit)
                kinds.append(",".join(dict.fromkeys(k for s in got if (k := kind_of(s)))) if hit else "")
            mask = pa.array(out, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), pa.array(kinds).filter(mask)], names=["record_id", "kinds"])

    return run


def residue_texts(records: DataFrame, id_col: str, text_col: str, spare: int = SPARE) -> DataFrame:
    """(record_id, kinds) of records whose text is only residue."""
    src = records.select(F.col(id_col).cast("string").alias("record_id"), F.col(text_col).alias("text")).where("record_id is not null and text is not null")
    return src.mapInArrow(_of_texts(spare), "record_id string, kinds string").distinct()


_JUDGED = T.StructType(wrappers._OUTLINE.fields + [T.StructField("mark", T.ArrayType(T.IntegerType())), T.StructField("own", T.ArrayType(T.LongType()))])
_ARROW = wrappers._ARROW.append(pa.field("mark", pa.list_(pa.int32()))).append(pa.field("own", pa.list_(pa.int64())))


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = wrappers.Keys()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            rows = []
            for name, rid, url, source in zip(*(c.to_pylist() for c in part.columns), strict=True):
                o = wrappers.outline(source, url, keys)
                if o:
                    mark = [judged(s) for s in o["raw"]]
                    # evidence is told from boilerplate by its own counts
                    own = [k for k, m in zip(o["key"], mark, strict=True) if m < 0]
                    key = [wrappers.OWN if m < 0 else k for k, m in zip(o["key"], mark, strict=True)]
                    rows.append(o | {"record_table": name, "record_id": rid, "doc": wrappers.address(o["host"], url or rid), "key": key, "mark": mark, "own": own})
            if rows:
                yield wrappers.batched(rows, _ARROW)


_WITH = "record_id string, host string, doc long, seen array<long>, kept array<long>, passage boolean"


def _of_pages(spare: int):
    """Of each page with evidence: the evidence on it and in its residual, and whether its residual has a passage."""
    names = ("no", "kind", "box", "structure", "link", "at", "size", "parent", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wrappers.Known(None)
        for batch in batches:
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            held.build = lambda k, cols=cols: wrappers.wrapper_of(cols, k)
            marks, own, hosts = (cols[n].to_pylist() for n in ("mark", "own", "host"))
            some = pa.array([bool(x) for x in own], pa.bool_())
            kept, passage = [], []
            for k, o in enumerate(wrappers.unbatched(cols, names)):
                if not own[k]:
                    continue
                no, left = set(wrappers.main_blocks(o, held(hosts[k], k))), 0
                evidence, mine = iter(own[k]), []
                for at, m in zip(o["at"], marks[k], strict=True):
                    key = next(evidence) if m < 0 else None
                    if o["no"][at] in no:
                        left += max(0, m)
                        if m < 0:
                            mine.append(key)
                kept.append(mine)
                passage.append(left > spare)
            yield pa.RecordBatch.from_arrays([*(cols[n].filter(some) for n in ("record_id", "host", "doc", "own")), pa.array(kept, pa.list_(pa.int64())), pa.array(passage, pa.bool_())], names=["record_id", "host", "doc", "seen", "kept", "passage"])

    return run


def residue_pages(pages: DataFrame, spare: int = SPARE, **how) -> DataFrame:
    """(record_id) of pages(record_table, record_id, url, html) whose residual is only residue."""
    out = written(pages.where("html is not null and record_id is not null").select("record_table", "record_id", "url", "html").mapInArrow(_outlines, _JUDGED), "p2-outlines")
    got = written(out.join(wrappers.kinds(wrappers.inferred(out, **how)), "host", "left").mapInArrow(_of_pages(spare), _WITH), "p2-evidence")
    each = got.select("host", "doc", "passage", F.explode(F.array_distinct("seen")).alias("key"))
    each = each.groupBy("host", "key", "doc").agg(F.max("passage").alias("passage")).groupBy("host", "key").agg(F.count("*").alias("n"), F.count_if("passage").alias("beside"))
    docs = out.select("host", "doc").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    notices = each.join(docs, "host").where((F.col("n") >= F.greatest(F.lit(wrappers.LEAST + 1), F.col("docs") * wrappers.HOST_SHARE)) & (2 * F.col("beside") > F.col("n"))).select("host", "key")
    hits = got.where("not passage").select("record_id", "host", F.explode("kept").alias("key"))
    return hits.join(notices, ["host", "key"], "left_anti").select("record_id").distinct()
