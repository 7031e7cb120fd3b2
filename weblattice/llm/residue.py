"""Template residue, filler and error pages instead of content.

Three grammars look at a text whose code (fenced or between backticks) is
blanked out first:

* placeholders: one small grammar per kind of delimiter, for what stands
  between the delimiters, up to the line's end. What is quoted or in code
  never counts; what the words around explain doesn't either, and where such
  explanations are dense the text is a tutorial;
* filler: passages that only stand for text to come;
* errors and notices: what a server or a script says instead of a page. These
  count as *served* only where they make up a line of their own, not where a
  sentence tells of them.

The grammars read every text that isn't empty, whole, in Python: a filter on
words before them would have to follow from each of their alternatives.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = r"[A-Za-z_][\w.\-]*"
WORDS = r"[A-Za-z][\w.\-]*(?:[ _][\w.\-]+){0,5}"
#: One grammar per delimiter: opening, what may stand inside, closing.
PLACEHOLDERS = {
    "braces": re.compile(r"\{\{\{?[#/^>&!]?\s*[A-Za-z_][^{}\n]*?\}?\}\}"),
    "block": re.compile(r"\{%-?\s*[a-z]+\b[^%\n]*?-?%\}"),
    "dollar": re.compile(r"\$\{\s*" + NAME + r"[^{}\n]*\}"),
    "hash": re.compile(r"#\{\s*" + NAME + r"[^{}\n]*\}"),
    "angle": re.compile(r"<%[=\-#]?\s*[A-Za-z_@][^%\n]*%>|<\?(?:php|=)[^?\n]*\?>"),
    "percent": re.compile(r"%%" + NAME + r"%%|%[A-Z][A-Z0-9]*_[A-Z0-9_]+%|%\(" + NAME + r"\)[sdrf]"),
    "wiki": re.compile(r"\[\[\s*[a-z_]+[._][\w.]+\s*\]\]"),
    "at": re.compile(r"@@?[A-Z][A-Z0-9]*_[A-Z0-9_]*@@?|@@" + NAME + r"@@"),
    "money": re.compile(r"\$\$" + NAME + r"\$\$"),
    "under": re.compile(r"(?<![\w])__[A-Z][A-Z0-9_]{2,}__(?![\w])"),
    "brace": re.compile(r"(?<![\w${#%])\{(?:\d{1,2}|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-z]+(?:_[a-z0-9]+)+)\}(?!\})"),
    "bracket": re.compile(
        r"\[\s*(?:INSERT|ADD|ENTER|REPLACE|PLACEHOLDER|TODO|TBD|YOUR|FILL)\b[^\]\n]*\]"
        r"|\[\s*(?:insert|enter|add|replace|placeholder|fill in|your)\b[^\]\n]*\]"
        r"|\[\s*(?:Insert|Enter|Add|Replace|Placeholder|Fill in|Your|Company|Site|Author|First|Last|Product|Page)(?: [A-Za-z]+){0,3} ?(?:name|here|title|text|date|link|url|anchor)?\s*\]",
    ),
    "chevron": re.compile(r"<(?:INSERT|YOUR|ENTER|PLACEHOLDER)[ _][A-Z_ ]{2,}>|(?:«|<<)\s*[A-Za-z]+[_.][\w.]+\s*(?:»|>>)"),
    "object": re.compile(r"\[object [A-Z]\w+\]"),
    "printf": re.compile(r"(?<!\w)%(?:\d\$)?[sd](?!\w)"),
}

_FILLER_LINES = (
    # Usual filler, by language.
    r"lorem ipsum\b", r"dolor sit amet\b", r"consectetur adipiscing",
    r"(?:(?:your )?(?:text|content|copy|description|headline|title) (?:goes|comes) here\W*)+",
    r"(?:insert|add|enter|place|replace) (?:your |this |the |some )?(?:text|content|paragraph|copy)(?: here)?(?: before publishing)?\W*",
    r"replace (?:this|the) (?:paragraph|text|section)\b.{0,30}",
    r"(?:sample|dummy|placeholder|example|filler|demo) (?:text|content|copy|paragraph)\b\W*.{0,50}",
    r"(?:the )?(?:quick brown fox jumps over the lazy dog)\W*",
    r"(?:[A-Za-z]+ )?(?:paragraph|section|text|copy|summary|intro(?:duction)?)\W{1,3}(?:is )?to be (?:written|added|done)\W*",
    r"\[[^\]\n]{0,40}\bto be (?:written|added|completed|confirmed|supplied)\]",
    r"(?:coming soon|under construction|content to follow)\W*",
    r"(?:TBD|TBA|TODO|FIXME)(?:\W+(?:TBD|TBA|TODO|FIXME))*\W*",
    r"(?:x{3,})(?:\W+[a-z]+)?\W+x{3,}\W*|x{3,}(?:\W+x{3,})*\W*",
    r"(?:(?:asdf|qwer|qwerty|zxcv|test|hjkl|foo|bar|blah|bla)\b[\s\d.,!]*){3,}",
    r"hier (?:steht|kommt|folgt)\b.{0,20}\b(?:text|inhalt)\b.{0,40}", r"(?:blind|beispiel|platzhalter|muster)text\b.{0,50}", r"bitte ersetzen\W*",
    r"(?:ceci est un |un )?(?:faux )?texte (?:d['’]exemple|de remplissage|provisoire|fictif)\b.{0,60}", r"à remplacer avant\b.{0,40}", r"(?:ici|votre) (?:vient )?(?:le|votre) texte\b.{0,40}",
    r"texto (?:de (?:ejemplo|relleno|prueba|muestra)|provisional|simulado)\b.{0,50}", r"(?:su|aquí va (?:su|el)) texto\b.{0,40}", r"sustituir antes de publicar\W*",
    r"texto (?:de (?:exemplo|preenchimento)|provisório|fictício)\b.{0,50}", r"(?:o seu|aqui vai o|insira o) texto\b.{0,40}", r"substituir antes de publicar\W*",
    r"testo (?:segnaposto|di (?:esempio|prova|riempimento)|provvisorio)\b.{0,50}", r"(?:inserire|qui va) (?:il )?testo\b.{0,40}", r"da sostituire\W*",
    r"(?:voorbeeld|opvul|plaatshouder|placeholder|voorlopige )tekst\b.{0,50}", r"(?:voorbeeld\w*, )?hier komt (?:de|het|uw)\b.{0,30}", r"vervang (?:deze|dit)\b.{0,40}",
)
#: Filler may follow a sentence; it must begin one and make it up.
FILLER = re.compile(r"\s*[\[(*#>\-• ]*(?:" + "|".join(_FILLER_LINES) + r")", re.I)

_CODE = r"(?:4\d\d|5\d\d)"
_ERRORS = (
    # What servers, scripts and gates say, by language.
    r"(?:error|erreur|errore|erro|fehler|fout)\s*:?\s*" + _CODE + r"\b.{0,120}",
    r"(?:http\s*)?" + _CODE + r"\s*[:\-–—|.]?\s*(?:error\b|not found|forbidden|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|internal server error|unauthorized|bad request|gone\b|too many requests).{0,80}",
    r"(?:http )?(?:error|erreur|errore|fehler|fout)?\s*" + _CODE + r"\s*:.{0,80}",
    r"(?:error|erreur|errore|erro|fehler|fout|fehlercode)\s*(?:n[o°.]\s*|code\s*|#)?\d{2,6}\s*:.{1,120}",
    r"(?:page|file|document|url|seite|datei) not found\b.{0,60}", r"not found\W*", r"(?:403 )?forbidden\W*", r"bad gateway\W*.{0,60}", r"internal server error\W*.{0,80}",
    r"service (?:temporarily )?unavailable\W*.{0,60}", r"gateway time-?out\W*.{0,60}",
    r"the requested (?:address|url|page|resource|file)\b.{0,80}\b(?:not (?:found|available)|could not|cannot)\b.{0,60}",
    r"(?:sorry|oops|whoops)\W.{0,60}\b(?:page|wrong|found|exist)\b.{0,60}", r"(?:the|that|this) page (?:has moved|does(?:n['’]t| not) exist|could(?:n['’]t| not) be found|cannot be found|is (?:missing|gone|unavailable)|you).{0,80}",
    r"access (?:denied|forbidden|to this page has been denied)\W.{0,80}", r"you (?:do not|don['’]t) have permission\b.{0,80}", r"your request (?:\d+ )?was blocked\b.{0,60}",
    r"too many requests\W.{0,80}", r"(?:slow down|try again later)\W*.{0,40}", r"rate limit exceeded\W*.{0,60}",
    r"could not connect to (?:the )?(?:database|server)\b.{0,60}", r"(?:error establishing a |no )?database connection\b.{0,40}", r"error code \d+\W*",
    r"(?:fatal error|parse error|syntax error|warning|notice|deprecated)\s*: .{0,100}\b(?:line \d+|\.php\b|function|undefined|unexpected|null)\b.{0,80}",
    r"(?:uncaught )?(?:\w+\.)*[A-Z]\w*(?:error|exception)\s*: .+", r"traceback \(most recent call last\)\W*", r"(?:exception in thread|stack trace)\b.{0,120}", r"segmentation fault\b.{0,40}",
    r"your session (?:has )?(?:expired|timed out)\b.{0,60}", r"(?:please )?(?:log|sign) ?in (?:again|to continue)\W*", r"(?:the )?(?:site|page) is (?:down for maintenance|temporarily unavailable|offline)\b.{0,60}",
    r"(?:die |diese )?(?:angeforderte )?seite (?:wurde |konnte |existiert |ist )?(?:leider )?nicht (?:gefunden|vorhanden|verfügbar|mehr)\b.{0,60}", r"zugriff verweigert\W*.{0,60}", r"(?:interner )?serverfehler\W*.{0,60}", r"dienst nicht verfügbar\W*.{0,40}",
    r"(?:cette )?page (?:est )?(?:introuvable|non trouvée|inexistante)\b.{0,60}", r"(?:la )?page demandée\b.{0,80}", r"accès (?:refusé|interdit)\W*.{0,60}", r"erreur (?:interne )?(?:du )?serveur\W*.{0,60}", r"service (?:temporairement )?indisponible\W*.{0,40}",
    r"(?:la )?página (?:no (?:encontrada|existe|disponible)|solicitada no)\b.{0,60}", r"no se (?:encuentra|encontró|ha encontrado) la página\b.{0,60}", r"acceso denegado\W*.{0,60}", r"error interno del servidor\W*.{0,40}", r"servicio no disponible\W*.{0,40}",
    r"(?:a )?página (?:não (?:encontrada|existe|disponível|foi encontrada)|solicitada não)\b.{0,60}", r"acesso negado\W*.{0,60}", r"erro interno d[oe] servidor\W*.{0,40}", r"serviço indisponível\W*.{0,40}",
    r"(?:la )?pagina (?:non (?:trovata|esiste|disponibile|è stata trovata)|richiesta non)\b.{0,60}", r"accesso negato\W*.{0,60}", r"errore interno del server\W*.{0,40}", r"servizio non disponibile\W*.{0,40}",
    r"(?:de |deze )?(?:opgevraagde )?pagina (?:is |werd |kon |bestaat )?niet (?:gevonden|beschikbaar|meer)?\b.{0,60}", r"toegang geweigerd\W*.{0,60}", r"interne serverfout\W*.{0,40}", r"dienst niet beschikbaar\W*.{0,40}",
)
_SCRIPT = r"(?:java ?script|scripts?|scripting|skripte?)"
_NOTICES = (
    r"(?:please |you (?:need|have|must) to |bitte )?(?:enable|turn on|activate|allow|switch on)\b.{0,24}\b" + _SCRIPT + r"\b.{0,80}",
    r"you (?:need|have) to (?:enable|turn on|allow)\b.{0,30}\b" + _SCRIPT + r"\b.{0,80}",
    r"(?:this|the|our) (?:site|page|app|application|website)\b.{0,40}\b(?:requires|needs|works best with|depends on|uses|relies on|will not work without)\b.{0,30}\b" + _SCRIPT + r"\b.{0,80}",
    r"your browser (?:has|does not|doesn['’]t)\b.{0,60}", r"java ?script (?:is|seems to be|must be|appears to be|has been)\b.{0,20}\b(?:disabled|required|off|enabled|needed|blocked)\b.{0,60}", r"(?:loading|please wait)\W{1,4}if nothing happens\b.{0,80}",
    r"if nothing happens\b.{0,80}", r"checking your browser\b.{0,80}", r"(?:scripts? and cookies|cookies and scripts?) must be on\W*", r"(?:verifying|confirm|verify) (?:that )?you are (?:a )?human\b.{0,60}",
    r"(?:bitte )?aktivieren sie\b.{0,20}\bjava ?script\b.{0,80}", r"java ?script (?:ist|muss|wird)\b.{0,60}", r"(?:diese|die) (?:seite|anwendung)\b.{0,30}\b(?:benötigt|braucht|erfordert)\b.{0,20}\bjava ?script\b.{0,60}",
    r"(?:veuillez |merci d['’])?activer java ?script\b.{0,80}", r"java ?script (?:est|doit)\b.{0,60}", r"ce(?:tte)? (?:site|page|application)\b.{0,30}\b(?:nécessite|requiert)\b.{0,20}\bjava ?script\b.{0,60}",
    r"(?:por favor,? )?(?:active|activa|habilite|habilita) java ?script\b.{0,80}", r"(?:esta|este) (?:página|sitio|aplicación)\b.{0,30}\b(?:requiere|necesita)\b.{0,20}\bjava ?script\b.{0,60}",
    r"(?:por favor,? )?(?:ative|ativar|habilite|ligue)\b(?: o)? java ?script\b.{0,80}", r"(?:esta|este) (?:página|site|sítio|aplicação)\b.{0,30}\b(?:requer|precisa|necessita)\b.{0,20}\bjava ?script\b.{0,60}",
    r"(?:si prega di )?(?:abilitare|attivare|abilita|attiva|attivi|abiliti) java ?script\b.{0,80}", r"(?:questa|questo) (?:pagina|sito|applicazione)\b.{0,30}\b(?:richiede|necessita)\b.{0,20}\bjava ?script\b.{0,60}",
    r"(?:schakel|zet|activeer)\b.{0,12}\bjava ?script\b.{0,80}", r"(?:deze|dit) (?:pagina|site|website|toepassing)\b.{0,30}\b(?:vereist|heeft)\b.{0,20}\bjava ?script\b.{0,60}",
)
SERVED = re.compile(r"\s*[\[(*#>\-•| ]*(?:(?:" + "|".join(_ERRORS) + r")|(?:" + "|".join(_NOTICES) + r"))\s*$", re.I)

#: Text next to a placeholder that tells what it is: before it, or after it.
_BEFORE = re.compile(
    r"\b(?:placeholders?|variables?|syntax|expressions?|delimiters?|markers?|macros?|tokens?|set|export|echo|write|type|e\.g\.|such as|named|called|"
    r"platzhalter|variable|ausdruck|schreibe|variables?|expression|écrivez|marcador|variable|escriba|marcador|variável|escreva|segnaposto|variabile|scrivi|plaatshouder|variabele|schrijf)"
    r"\s*:?\s*(?:a |an |the |der |die |le |la |el |o |il |de |het )?$", re.I
)
_AFTER = re.compile(
    r"^\W{0,3}(?:(?:is|are|gets?|will be|wird|est|es|è|é|wordt) (?:replaced|filled|substituted|expanded|rendered|ersetzt|remplacée?|sustituid[oa]|substituíd[oa]|sostituit[oa]|vervangen)|stands for|expands|renders|"
    r"syntax|placeholder|variable|expression|notation|before running)\b", re.I
)
#: Words that make a line a heading or sentence about a message, not the message.
ABOUT = re.compile(
    r"\b(?:what (?:it|they|this|that) means?|how (?:to|we|i)\b|explained|lessons?|guide to|tips|why|causes?|examples? of|in this (?:article|post|guide|chapter)|(?:is|was|are|were) (?:the|a|an|what|when)\b|"
    r"dates (?:from|back)|comes from|bedeutet|was .{1,20} bedeutet|signifie|significa|betekent|expliqué|explicado|spiegato|uitgelegd|erklärt)", re.I
)

#: Filler that no sentence uses, wherever it stands.
GIBBERISH = re.compile(r"\blorem ipsum (?:dolor|sit)|\b(?:asdf|qwer|zxcv)\w*(?:[\s,.]+(?:asdf|qwer|zxcv|test)\w*){2,}", re.I)
FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
FENCE_INLINE = re.compile(r"```.*?(?:```|\Z)", re.S)
TICKS = re.compile(r"(`+)(?!`)[^`\n]*(?:\n[^`\n]+)*\1(?!`)")
QUOTES = re.compile(r"\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|«[^»\n]{1,80}»|‘[^’\n]{1,80}’")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
LOG = re.compile(r"^\s*(?:[>*\-]\s*)?\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|^\s*\d{1,3}(?:\.\d{1,3}){3}\s")

def blank_code(text: str) -> str:
    """The text with fenced and back-ticked passages blanked, lines kept."""
    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m.group())

    return TICKS.sub(blank, FENCE_INLINE.sub(blank, FENCE.sub(blank, text))) if "`" in text or "~~~" in text else text


def findings(text: str | None) -> list[tuple[str, str]]:
    """(kind, passage) of each residue in a text; kinds are placeholder, filler and served."""
    if not text:
        return []
    visible = blank_code(unicodedata.normalize("NFC", text))
    out = [("placeholder", p) for p in unfilled(visible)]
    out += [("filler", m.group()) for m in GIBBERISH.finditer(visible) if not ABOUT.search(_sentence(visible, m.end()))]
    for line in visible.split("\n"):
        if not line.strip() or LOG.match(line):
            continue
        bare = QUOTES.sub(" ", line)
        # A line served instead of content consists of such messages alone ...
        if SERVED.match(bare) and _telling(bare):
            out.append(("served", line.strip()))
            continue
        parts = SENTENCE.split(bare.strip())
        # ... or begins with one that is no part of a longer tale.
        for k, part in enumerate(parts):
            if FILLER.fullmatch(part) and not ABOUT.search(part):
                out.append(("filler", part))
            elif SERVED.fullmatch(part) and _telling(part):
                out.append(("served", part))
    return out


#: Words of someone telling: such a sentence reports a message of another page.
TALE = re.compile(
    r"\b(?:we|our|visitors?|the crawl(?:er)?|answered|retried|listed|links? back|wrote|returned|reports?|met|who|because|wir|nous|nosotros|nós|noi|wij)\b", re.I
)


def _telling(part: str) -> bool:
    """Whether nothing marks the sentence as a tale about other pages, or about the message itself."""
    return not TALE.search(part) and not ABOUT.search(part)


def _sentence(text: str, at: int) -> str:
    """The rest of the sentence from a place on."""
    end = re.search(r"[.!?…](?:\s|$)|\n|\Z", text[at:])
    return text[at : at + end.start()]


def unfilled(visible: str) -> list[str]:
    """The placeholders of a text whose code is blanked, less those of a tutorial.

    Context: a placeholder is explained if the words next to it say what it is.
    Density: where explained ones are at least half of all, the text is about
    templates and none counts; else the explained ones alone fall out.
    """
    hits = [m for p in PLACEHOLDERS.values() for m in p.finditer(visible)]
    if not hits:
        return []
    told = [bool(_BEFORE.search(visible[max(0, m.start() - 60) : m.start()]) or _AFTER.search(visible[m.end() : m.end() + 60])) for m in hits]
    return [] if 2 * sum(told) >= len(hits) else [m.group() for m, t in zip(hits, told) if not t]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("passage", pa.string())]))
    for b in batches:
        at, out = [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            found = findings(t)
            if found:
                at.append(i)
                out.append([{"kind": k, "passage": p[:200]} for k, p in found[:20]])
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(out, kind)], names=["_id", "findings"])


def residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, findings) of each document that holds residue.

    Null, empty and very short texts without residue are no cases. Repeated
    keys come out once per row. ``findings`` shows at most 20 passages of at
    most 200 characters; whether a document is a case never depends on that.
    """
    near = docs.select(F.col(key).alias("_id"), F.col(text).alias("_t")).where("_t != ''")
    return near.mapInArrow(_run, f"_id {near.schema['_id'].dataType.simpleString()}, findings array<struct<kind:string,passage:string>>").withColumnRenamed("_id", key)


def without_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no residue, with all their columns; null keys and texts stay."""
    bad = residue(docs, key, text).select(F.col(key).alias("_bad")).distinct()
    return docs.join(bad, docs[key] == bad["_bad"], "left_anti")
