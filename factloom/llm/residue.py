"""Template residue, filler, error pages and script notices in place of content.

A multi-pattern automaton with phrases in English, Spanish, French, German and Croatian, with openers of slots and
with words of notes goes over the whole text once. Where it hits decides what is looked at closer, and only there:

* slots: at an opener, a template slot left open up to its closer, a missing value that a program printed, a stand-in
  note for a passage still to be written, in brackets. One is enough, anywhere, unless the text merely quotes or
  mentions it in the same sentence.
* filler: a run of dummy words, a placeholder sentence that is repeated, a list of dummy fields or
  dummy lines, be it the whole text or a section of it; a line covered by placeholder phrases.
* message: what is left of a page without markup, menu lines, footer and headline is covered by
  error, access or script messages to at least ``COVERED`` of its letters. A sentence of which phrases make up
  ``OWN`` of the letters counts as covered. Real content beside a message keeps the coverage low.

No length is a limit. Null, empty and blank texts have no residue.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of letters that messages must cover.
COVERED = 0.7
#: Words in a row that make filler, and repeats of a sentence or line.
RUN, REPEATS = 4, 3
#: Most words of a note; what is longer is prose in brackets.
NOTE_WORDS = 12
#: Share of a sentence's letters from which on its phrases stand for the whole of it.
OWN = 0.6

# Messages of servers, applications and access checks.
MESSAGES = """
404 not found|page not found|not found on this server|the requested url|the requested resource|is gone|410 gone|500 internal server error|internal server error
the server encountered an unexpected condition|could not complete your request|502 bad gateway|bad gateway|503 service temporarily unavailable|service temporarily unavailable
503 service unavailable|service unavailable|504 gateway timeout|gateway timeout|gateway time-out|403 forbidden|401 unauthorized|400 bad request|forbidden|access denied|permission denied
you don't have permission to access|you do not have permission|on this server|reference #|error 1020|you have been blocked|request id|upstream connect error|disconnect before headers
reset reason|too many requests|please wait|and try again|try again later|please try again|checking if the connection is secure|checking your browser|verify you are human|by completing the action below
needs to review the security of your connection|are you a robot|complete the captcha|unusual traffic|error establishing a database connection|database connection|down for scheduled maintenance|we're down for
scheduled maintenance|under maintenance|please check back soon|check back soon|be back soon|we'll be back|http status|type exception report|exception report|resolver failed
at line|nullpointerexception|exception in thread|stack trace|traceback (most recent call last)|keyerror|typeerror|valueerror|in page|fatal error|parse error|warning: cannot open stream
cannot open stream|failed to open stream|on line|sqlstate|general error|syntax error|oops!|we can't find that page|can't find that page|it may have been moved or deleted|moved or deleted|go back to the homepage
the page you are looking for|does not exist|doesn't exist|no longer available|no longer exists|has been removed|by its publisher|sorry, this article|sorry, this page|you will be redirected|in 2 seconds|seconds
this content is not available in your region|not available in your region|not available in your country|your session has expired|session has expired|sign in again to continue|sign in to continue|please log in
something went wrong|an error occurred|an unexpected error|nosuchkey|could not be loaded|failed to load|unable to load|connection refused|connection timed out|request timed out|ad blocker detected|disable it and
can't be displayed|cannot be displayed|can not be displayed|could not be displayed|can't be reached|cannot be reached|is not responding|took too long to respond|temporarily unavailable|currently unavailable|unavailable right now|right now
are overloaded|is overloaded|too busy|experiencing technical difficulties|technical difficulties|bad request|method not allowed|not acceptable|request timeout|payload too large|rate limit exceeded|you have exceeded|ip address has been|has been blocked|blocked by
security check|press and hold|prove you are not a robot|i'm not a robot|not authorized|unauthorized|authentication required|login required|this link has expired|link is broken|broken link|page has moved|page was not found|could not be found|couldn't find|cannot find
no se puede mostrar|no se pudo cargar|no existe|ha caducado|inicie sesión|fuera de servicio|servidor ocupado|error del servidor|ne peut pas être affichée|n'existe pas|a expiré|erreur interne|hors service|kann nicht angezeigt werden|existiert nicht|ist abgelaufen|melden sie sich an|serverfehler|überlastet
ne može se prikazati|ne postoji|je istekla|prijavite se|pogreška poslužitelja|nije dostupna|preopterećen
backend fetch failed|guru meditation|error 503|error 502|error 500|error 404|error 403|you are unable to access|unable to access this site|this site can't be reached|this site|the connection was reset|connection was reset|connection was interrupted|has been moved|was moved
or misconfiguration|was unable to complete your request|unable to complete|encountered an internal error|an internal error|the server encountered|just a moment|before accessing|please stand by|verifying you are human|needs to verify|this may take a few seconds|this process is automatic|host error|origin is unreachable|dns resolution error|ssl handshake failed
la página que busca|la página que buscas|ha sido movida|ha sido eliminada|ha ocurrido un error|error interno del servidor|acceso restringido|contenido no disponible|cette page n'existe pas|ou a été déplacée|a été déplacée|a été supprimée|la page que vous recherchez|la page que vous cherchez|accès interdit|accès restreint|erreur interne du serveur|contenu indisponible|veuillez patienter
diese seite existiert nicht|oder wurde verschoben|wurde verschoben|wurde gelöscht|die angeforderte seite|die gesuchte seite|wurde nicht gefunden|interner serverfehler|zugriff nicht gestattet|inhalt nicht verfügbar|bitte warten|tražena stranica|premještena|uklonjena|interna pogreška poslužitelja|pristup zabranjen|sadržaj nije dostupan|pokušajte ponovo|došlo je do greške|molimo pričekajte
lo sentimos|se ha producido un error|error inesperado|página no encontrada|no se ha encontrado la página|no encontramos la página|volver al inicio|acceso denegado|no tiene permiso para ver esta página|no tiene permiso
el servicio no está disponible en este momento|no está disponible|inténtelo de nuevo más tarde|inténtelo más tarde|en mantenimiento|demasiadas solicitudes
page introuvable|la page demandée est introuvable|est introuvable|erreur 404|accès refusé|vous n'êtes pas autorisé à consulter cette page|vous n'êtes pas autorisé|service momentanément indisponible|momentanément indisponible
veuillez réessayer plus tard|réessayez plus tard|retour à l'accueil|une erreur s'est produite|en cours de maintenance|trop de requêtes
seite nicht gefunden|nicht gefunden|zurück zur startseite|zugriff verweigert|fehlercode|wartungsarbeiten|diese seite ist vorübergehend nicht erreichbar|vorübergehend nicht erreichbar|nicht erreichbar
ein fehler ist aufgetreten|es ist ein fehler aufgetreten|bitte versuchen sie es später erneut|später erneut|zu viele anfragen|keine berechtigung
stranica nije pronađena|nije pronađena|greška 404|pristup odbijen|nemate ovlasti za pregled ove stranice|nemate ovlasti|poslužitelj trenutačno nije dostupan|trenutačno nije dostupan|pokušajte ponovno kasnije|pokušajte kasnije
došlo je do pogreške|održavanje u tijeku|povratak na početnu|previše zahtjeva
"""
# Notices about scripts, cookies and the browser.
NOTICES = """
you need to enable javascript to run this app|please enable js|enable js|disable any ad blocker|enable javascript|please enable cookies and javascript to continue|enable cookies|javascript is disabled|javascript is required|requires javascript|please turn it on and reload the page
turn it on and reload|this site requires scripts|requires scripts|your browser does not support them|or they are switched off|they are switched off|your browser does not support|turn scripts on|reload.|that's all we know
if nothing happens, allow scripts for|if nothing happens|allow scripts|loading…|loading...|noscript|content for|enable scripts to read on|enable scripts|your browser is out of date|is out of date|update it to view|update your browser
correctly|unsupported browser|cookies are disabled|accept cookies to continue|to continue to
para ver esta página es necesario activar javascript|es necesario activar javascript|active javascript|habilite los scripts y las cookies en su navegador para continuar|habilite los scripts|habilite las cookies|su navegador no
veuillez activer javascript pour afficher ce site|activer javascript|ce site nécessite l'exécution de scripts|nécessite l'exécution de scripts|nécessite javascript|activez les cookies|votre navigateur ne
ohne skripte kann der inhalt nicht angezeigt werden|ohne skripte|bitte aktivieren sie javascript|um diese seite zu sehen|um diese seite zu nutzen|um diese website zu nutzen|um diese seite anzuzeigen|um fortzufahren|javascript aktivieren|aktivieren sie javascript|aktivieren sie cookies|ihr browser unterstützt|ihr browser ist veraltet
za prikaz ove stranice uključite javascript|uključite javascript|omogućite javascript|vaš preglednik ne izvršava skripte potrebne za ovu stranicu|vaš preglednik|omogućite kolačiće
"""
# Sentences that hold a place.
PLACEHOLDERS = """
lorem ipsum|dolor sit amet|your text goes here|text goes here|headline goes here|title goes here|copy goes here|content goes here|caption goes here|quote goes here|synopsis goes here|summary goes here|insert body copy here|body copy here|insert text here|placeholder text|replace before publishing|sample paragraph|sample text|dummy text|filler text
todo: write this section|write this section|content coming soon|texto de prueba|escriba aquí su texto|escriba su texto aquí|inserte aquí|texto de relleno|texto de ejemplo|aquí va el cuerpo de la noticia|aquí va el texto|texte à remplacer|texte de remplissage|faux texte|texte d'exemple|ceci est un texte d'essai|texte d'essai
votre texte ici|platzhalter, bitte ersetzen|platzhalter|blindtext|beispieltext|fülltext|hier steht ihr text|dies ist ein blindtext|hier text einfügen|ovdje ide tekst|ovdje upišite tekst|upišite tekst|ovdje dolazi tekst|zamjenski tekst|probni tekst|tekst u pripremi, zamijeniti prije objave|tekst u pripremi|zamijeniti prije objave|tekst za popunjavanje|primjer teksta
"""
# Words of dummy Latin and of keyboard filler.
DUMMY_LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo
consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
nam nunc donec massa eget viverra sagittis turpis vestibulum pellentesque habitant morbi tristique senectus netus malesuada fames egestas tempus mauris vitae ultricies leo integer feugiat scelerisque varius rhoncus vulputate arcu dictum
suspendisse potenti cras ornare quam nec ligula ullamcorper blandit volutpat maecenas aliquet lacinia quisque euismod pharetra praesent elementum facilisis curabitur gravida fermentum iaculis purus faucibus interdum tellus molestie hendrerit
nihil minima tempora dolorum dolores eos ratione sequi nesciunt neque porro quisquam dolorem ipsam voluptatem quia voluptas aspernatur aut odit fugit magni modi incidunt quaerat corporis suscipit laboriosam vero accusamus iusto odio
"""
#: Words without which hardly any sentence of these languages gets along.
FUNCTION_WORDS = """
the and of to is was for with that on at by from it as are has have this but or be his her they which who el los las de que y en un una por con del al su como para pero más lo le les des du une dans pour sur pas plus ce cette qui ne au aux par son sa
der die das und ist nicht ein eine von mit den dem des im zu auf für sich auch als aus nach wird je i u na se da su za od koji koja nije s o kao ali iz će
"""
JUNK = "foo bar baz qux asdf asdfgh asdfghjkl qwerty qwertz azerty jkl blah bla test xxx xxxx xxxxx aaa bbb abc hjkl zzz"
# What a field of a dummy record says, and lines that stand for nothing.
FIELD_NAMES = "title|subtitle|heading|headline|lead|body|caption|summary|teaser|text|paragraph"
FIELD = rf"(?:{FIELD_NAMES})\s*\d+\s*:\s*(?:text|example|lorem|lorem ipsum|copy|to be added|sample|dummy|placeholder|tbd|n/a)\.?"
EMPTY_LINE = r"(?:n/?a|tbd|tba|tbc|tk|todo|null|none|x{3,}|\.{3,}|…|-+|_{3,}|\?{3,}|lorem|text|xx+)\.?"
# Names of fields that occur in slots written like ordinary brackets.
FIELDS = {
    "title", "count", "provider", "season", "date", "author", "year", "network", "city", "name", "show", "series", "episode", "link", "url", "source",
    "first_name", "last_name", "source_name", "season_number", "release_year", "provider_name", "show_name", "release_date", "series_title", "episode_count", "headline", "summary", "body", "image", "caption", "quote", "tk", "tbd", "tbc", "tba",
    "titel", "datum", "jahr", "titre", "année", "título", "fecha", "año", "naslov", "godina", "provider name", "series title", "release date",
}
# Those of them that an editor may add to a quotation, in brackets.
ADDED = set("city name show series season episode network year date author count".split())
# Words of notes that stand for a passage.
NOTE = (
    r"insert|paste|goes here|go here|to come|tk\b|tbd\b|placeholder|add (?:a |the )?(?:quote|link|photo|image|caption|text)|caption here|quote here|text here|photo here|image here|about the (?:series|show|network|company)"
    r"|aquí va|insertar|pegar|por añadir|pendiente|à venir|à compléter|insérer|coller|ici le|einfügen|folgt\b|hier (?:steht|kommt)|ergänzen|ovdje (?:ide|dolazi)|umetn|dodati|dopuniti"
)
# Elements of HTML, whose tags are markup.
HTML = set(
    "a abbr article aside b blockquote body br button caption center cite code col dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins label li link main mark meta nav noscript ol option p path picture pre q s script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time tr tt u ul var video".split()
)

_FIELD_NAMES = {f.replace("_", "").replace(" ", "") for f in FIELDS}
_FIELD_WORDS = {w for f in FIELDS for w in f.replace("_", " ").split()}
_PLAIN = r"[^\W\d]\w*(?:[.|]\s?\w+)*"
_NAME = _PLAIN + r"(?:\[\d+\])?"
#: Slots that need no further look: openers of template languages with what belongs into them, whatever its
#: length; it holds no further opener, so that openers without closer cost no more than one look at the text.
SLOT = re.compile(
    r"\{\{(?:(?!\{\{|\}\}).)*\}\}|\$\{(?:(?!\$\{)[^}])*\}|\{%(?:(?!\{%|%\}).)*%\}|<%(?:(?!<%|%>).)*%>|<\?(?:(?!<\?|\?>).)*\?>|<!--\s*#\s?\w+(?:(?!<!--|-->).)*(?:-->|$)|<!--\s*[\w.]+(?:\[\d+\])?\s*-->|\*\|(?:(?!\*\||\|\*).)+\|\*|\[%(?:(?!\[%|%\]).)*%\]|\{\$\w[\w.>-]*\}|%%\w+%%|\$[A-Za-z_][\w.]{2,40}(?:\[\d+\])?\$|~~[A-Za-z_][\w.]*(?:\[\d+\])?~~|\bMISSING_[A-Z]+\b|\[INSERT [^\n]{1,60}? HERE\]|\$[A-Z]{2,}(?:_[A-Z]+)+\b|\bTODO\s*:|\bFIXME\b|%\([\w.]+(?:\[\d+\])?\)[sd]|(?<![\w%])%[sd](?!\w)|%[A-Za-z_]{3,40}%|#\{(?:(?!#\{)[^}])+\}"
    rf"|\[\s*{_PLAIN}\[\d+\]\s*\]|\[\[\s*{_NAME}(?::\w+)?\s*\]\]|__{_NAME}__|@@{_NAME}@@|\#\#+{_NAME}\#\#+|<<\s*{_NAME}\s*>>|\[object \w+\]|\*\*\*[^*\n]{{0,60}}(?:goes here|to come|here)\s*\*\*\*|\bTK TK\b|(?<!\w)X{{4,}}(?!\w)|(?<!\w)NaN(?!\w)|(?<![?!\w])\?{{4,}}(?![?!])",
    re.IGNORECASE | re.DOTALL,
)
#: Slots that are names or words of ordinary text elsewhere.
_LOOSE = re.compile(r"todo\s*:|x{4,}|nan|tk tk", re.IGNORECASE)
_BRACE = re.compile(rf"(?<![{{$#\w])\{{\s*({_NAME}|\d{{1,2}})\s*\}}(?!\}})")
_BRACKET = re.compile(r"(?<!\[)\[([^\[\]\n]{1,80})\](?!\])")
_LEAKED = re.compile(r"(?<![A-Za-z_#])[A-Z]{2,}(?:_[A-Z]{2,})+(?![A-Za-z_])")
_TAG = re.compile(rf"<({_NAME})>")
_PROSE_TAG = re.compile(r"<[^\W\d][^<>=\"/\n]*\s[^<>=\"/\n]*>")
_NOTE_LAST = re.compile(rf"\b(?:{NOTE})\W*$", re.IGNORECASE)
_NOTE = re.compile(rf"(?:^|\b)(?:{NOTE})", re.IGNORECASE)
#: What stands before a value that a program printed, and such values.
_BEFORE = re.compile(r"(?:\d[.,]|\b(?:by|at|to|from|after|for|in|of|with|than|season|episode|the|von|um|mit|am|in|für|de|la|del|por|para|en|le|avec|pour|à|u|na|za|od|je)\s+|[/“„«(])$")
_OPENS = re.compile(r"(?:^|[.!?:]\s+)$")
_VALUE = re.compile(r"(undefined|null|nan|None(?! of\b)|nil)(['’]s\b)?(?![\w-])")
_NATURAL = re.compile(
    r"\b(?:left|leaves?|leaving|remains?|remained|is|was|are|were|be|been|stays?|stayed)\s+(?:\w+\s+){0,3}(?:undefined|null|nil)\b|\b(?:an?|the|as|still|yet|largely|deliberately)\s+undefined\b"
    r"|\b(?:undefined|null|none|nil) (?:on purpose|behaviou?r|role|term|number|time|period|end|date|of|but|and void)\b", re.IGNORECASE,
)
#: Words for signs and their use: a sentence with one of them speaks of the sign.
_MENTION = re.compile(
    r"\b(?:stylised|stylized|spelled|spelt|braces?|brackets?|logos?|tags?|markup|syntax|trademarks?|symbols?|placeholders?|literally"
    r"|klammern?|platzhalter|schriftzug|accolades?|crochets?|balises?|llaves?|corchetes?|etiquetas?|zagrad\w*|oznak\w*|znak\w*|logotip\w*)\b", re.IGNORECASE,
)
#: Names of slots that are ordinary words; in plain brackets one alone may be an editor's addition.
_TRIGGERS = (
    "{", "#{", "%", "<", "[", "__", "~~", "missing_", "@@", "##", "***", "xxxx", "undefined", "null", "none", "nil", "nan", "tk tk", "*|", "todo", "fixme", "$", "????",
)
_BOILER = re.compile(
    r"^\W*$|[|>·›»•].*[|>·›»•]|^\W*(?:©|\(c\)|copyright)|all rights reserved|^published by\b|^(?:menu|search|sign in|log in|newsletter|follow us|rss|share|contact|privacy|terms|skip to content|back to top|home|suche|buscar|rechercher|traži|izbornik|menü|menú)\W*$"
    r"|^(?:[\w-]+\.)+(?:example|com|org|net|tv|hr|es|de|fr)\W*$|^(?:[a-z]{2}\s+)+[a-z]{2}$|^(?:home|start(?:seite)?|inicio|accueil|naslovnica)\s*[>|›]|^(?:nginx|apache|proxy|cloudflare|openresty)[/\d.]*$",
    re.IGNORECASE,
)
#: Messages around a name of any kind, which counts as covered.
_FRAMES = re.compile(r"content (?:for|of) .{1,80} could not be (?:loaded|displayed)|(?:update|upgrade) (?:it|your browser) to (?:view|use|see) .{1,60}(?: correctly|$)|(?:allow|enable) (?:scripts|cookies|javascript) for .{1,60}$", re.IGNORECASE)
_FRAME_STARTS = re.compile(r"content (?:for|of) |(?:update|upgrade) (?:it|your browser) to |(?:allow|enable) (?:scripts|cookies|javascript) for ", re.IGNORECASE)
#: Elements without content of the page: comments, styles, scripts, menus and footers; then tags.
_UNSEEN = re.compile(r"<!--(?:(?!<!--|-->).)*-->|<(style|script|nav|footer)\b(?:(?!<\1\b|</\1).)*</\1\s*>", re.IGNORECASE | re.DOTALL)
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*;?")
#: What varies in messages: numbers, ids, hosts, paths, quoted names, JSON keys.
_NEUTRAL = re.compile(r"https?://\S+|(?:[\w-]+\.)+[a-z]{2,}\b|/[\w./-]+|\"[^\"\n]*\"|'[^'\n]{0,80}'|\b[\w.]*\d[\w.:-]*\b|\([^()\n]{0,40}\)|\bat [\w.$/]+\([^()\n]*\)|\bcaused by:|\.\.\. \d+ more\b|\b(?:file|line|code|ray|ref|status|message|trace|type|java|lang|tv|site|error|fehler|erreur|greška|key|requestid|hostid)\b", re.IGNORECASE)
_SPLIT = re.compile(r"(?<=[.!?])\s+|\n+")
_ENDS = re.compile(r"(?<=[.!?]\s)")


def _phrases(block: str) -> list[str]:
    return [p.strip() for line in block.strip().split("\n") for p in line.split("|") if p.strip()]


_LATIN, _JUNK, _FUNCTION = frozenset(DUMMY_LATIN.split()), frozenset(JUNK.split()), frozenset(FUNCTION_WORDS.split())
#: Words of the dummy vocabulary that are ordinary ones in some language; they don't count by themselves.
_ORDINARY = frozenset("sit do in id ad ex ea et est non qui sed ut labor massa bar test bla abc anim minima nulla".split())


def _wordings(pattern: str) -> list[str]:
    """The plain wordings of a pattern of alternatives, in brackets, some of them optional."""
    out = [""]
    for m in re.finditer(r"\(\?:([^()]*)\)(\?)?|\\b|([^()\\])", pattern):
        choices = [m[3]] if m[3] else [*m[1].split("|"), *([""] if m[2] else [])] if m[1] is not None else [""]
        out = [x + c for x in out for c in choices]
    return out


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern outside brackets."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@lru_cache(maxsize=1)
def automaton():
    """One automaton for everything: phrases carry their class, slot openers and dummy words too."""
    import ahocorasick

    kinds: dict[str, set[str]] = {}
    dummy = [w for w in _LATIN if len(w) >= 5 and w not in _ORDINARY | _PARTS] + ["asdf", "qwert", "blah", "foo ", "xxx", "aaa ", "test test"]
    notes = [w.strip().lower() for x in _alternatives(NOTE) for w in _wordings(x)]
    fields = [f"{w}{gap}{n}" for w in FIELD_NAMES.split("|") for gap in ("", " ") for n in range(10)]
    for kind, words in (
        ("slot", _TRIGGERS), ("note", notes), ("dummy", dummy), ("field", fields), ("filler", _phrases(PLACEHOLDERS)), ("notice", _phrases(NOTICES)), ("message", _phrases(MESSAGES)),
    ):
        for word in words:
            kinds.setdefault(word, set()).add(kind)
    found = ahocorasick.Automaton()
    for word, its in kinds.items():
        found.add_word(word, (frozenset(its), len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """Lower case, sign for sign: the one capital whose small form has two signs becomes a plain one."""
    return text.replace("\u0130", "i").lower()


#: Words of it that are also parts of ordinary words; they don't start a check.
_PARTS = frozenset("tempor tempora dolor dolore magna culpa minim minima velit officia veniam commodo labore laboris aliqua aliquip nostrud mollit tempora exerci sagittis quaerat conse".split())


def _sentence(text: str, start: int, end: int) -> tuple[int, int]:
    """Where the sentence or line around a place begins and ends."""
    begin = max(text.rfind(x, 0, start) + len(x) for x in (". ", "! ", "? ", "\n") if text.rfind(x, 0, start) >= 0) if any(text.rfind(x, 0, start) >= 0 for x in (". ", "! ", "? ", "\n")) else 0
    ends = [at for at in (text.find(x, end) for x in (". ", "! ", "? ", "\n")) if at >= 0]
    return begin, min(ends, default=len(text))


def _mentioned(text: str, start: int, end: int) -> bool:
    return _MENTION.search(text, *_sentence(text, start, end)) is not None


def _quoted(text: str, start: int) -> bool:
    """Inside quotation marks that were opened in the same sentence."""
    begin, _ = _sentence(text, start, start)
    low = text.rfind("„", begin, start)
    if low >= 0:
        return low > max(text.rfind("“", begin, start), text.rfind("”", begin, start))
    return any(text.rfind(a, begin, start) > text.rfind(b, begin, start) for a, b in (("“", "”"), ("«", "»")))


def _bracketed(text: str, m: re.Match) -> bool | str:
    """Whether plain brackets hold a note or a name of a field; the name alone where it is an ordinary word."""
    inner = m[1].strip()
    if _NOTE.match(inner) or _NOTE_LAST.search(inner) or re.search(r"\b(?:TBC|TBD|TBA|TK)\b", inner):
        return True
    if re.fullmatch(r"[a-z]+(?:[A-Z][a-z]+)+|\w+(?:_\w+)+", inner) and not inner[0].isdigit():
        return True
    name = inner.casefold()
    if inner.isupper() and " " in inner and all(w in _FIELD_WORDS for w in name.split()):
        return True
    if name in FIELDS or name in _FIELD_NAMES:
        if inner.isupper() or name not in ADDED:
            return inner.isupper() or not _quoted(text, m.start())
        return False if _quoted(text, m.start()) else name
    return False


def _printed(text: str, at: int) -> bool:
    """A missing value as a program prints it, where a text can't have that word."""
    m = _VALUE.match(text, at)
    if not m or at and text[at - 1].isalpha():
        return False
    if m[1] == "nan" or not (m[2] or m[1] == "undefined" or _BEFORE.search(text[max(0, at - 12) : at]) or m[1] == "null" and _OPENS.search(text[max(0, at - 4) : at])):
        return False
    return not any(x.start() <= at < x.end() for x in _NATURAL.finditer(text, *_sentence(text, at, m.end())))


def _loose(text: str, m: re.Match) -> bool:
    """Whether what could be an ordinary word is one: within a sentence, or spoken of."""
    if m[0].lower().startswith("todo"):
        return not re.search(r"(?:^|[.!?:;>*#/\n(\[{-])\s*$", text[max(0, m.start() - 3) : m.start()])
    return _mentioned(text, m.start(), m.end())


def open_slot(text: str, places: list[int]) -> bool:
    """A slot or a printed missing value at one of the places of openers that the text doesn't merely mention."""
    words: list[str] = []
    for at in places:
        m = SLOT.match(text, at)
        if m:
            if _LOOSE.fullmatch(m[0]) and _loose(text, m):
                continue
            return True
        c = text[at]
        if c == "{":
            m = _BRACE.match(text, at)
            if m and not _mentioned(text, m.start(), m.end()):
                return True
        elif c == "[":
            m = _BRACKET.match(text, at)
            told = _bracketed(text, m) if m else False
            if told is True:
                return True
            if told:
                words.append(told)
        elif c == "<":
            m = _TAG.match(text, at)
            if m and m[1].casefold() not in HTML and f"</{m[1]}" not in text and not _mentioned(text, m.start(), m.end()):
                return True
            m = _PROSE_TAG.match(text, at)
            if m and (m[0][1:].split()[0].casefold() not in HTML and _NOTE.search(m[0]) or re.search(r"\bwords?>$", m[0])):
                return True
        elif _printed(text, at):
            return True
    return len(words) > 1


def open_note(text: str, places: list[int]) -> bool:
    """A stand-in note in round brackets around one of the places of its words."""
    for at in places:
        begin = max(text.rfind(x, 0, at) for x in "()\n")
        ends = [x for x in (text.find(c, at) for c in "()\n") if x >= 0]
        if begin >= 0 and text[begin] == "(" and ends and text[min(ends)] == ")" and _NOTE.search(text, at, min(ends)) and len(text[begin : min(ends)].split()) <= NOTE_WORDS:
            return True
    return False


def leaked_names(text: str) -> bool:
    """Names of fields in capitals as programs write them."""
    return any(all(w in _FIELD_WORDS for w in m[0].lower().split("_")) for m in _LEAKED.finditer(text))


def _dummy_run(text: str) -> bool:
    """``RUN`` dummy words in a row of one vocabulary, with other words in between now and then."""
    for vocabulary in (_LATIN, _JUNK):
        run = miss = own = 0
        for m in _WORD.finditer(text):
            word = m[0].lower().rstrip(";")
            if word in vocabulary:
                run, miss = run + 1, 0
                own += word not in _ORDINARY
                if run >= RUN and own >= 3:
                    return True
            else:
                miss += 1
                if miss > 1:
                    run = own = 0
    return False


_FIELD_LINE, _NOTHING = re.compile(FIELD), re.compile(EMPTY_LINE)


def _repeats(text: str, kinds: set[str]) -> bool:
    """The same short sentence or dummy line ``REPEATS`` times in a row, or as many dummy fields."""
    if "field" not in kinds:
        quick = [x.strip(" .!?\t\r") for x in lowered(text).replace("! ", ". ").replace("? ", ". ").replace("\n", ". ").split(". ")]
        quick = [x for x in quick if x] if "..." not in text else quick
        if len(set(quick)) == len(quick):
            return False
    before, same, fields = "", 0, 0
    for part in _SPLIT.split(text):
        part = part.strip().casefold()
        if not part:
            continue
        fields = fields + 1 if ":" in part and _FIELD_LINE.fullmatch(part) else 0
        same = same + 1 if part == before else 1
        before = part
        empty = _NOTHING.fullmatch(part) is not None
        if fields >= REPEATS or same >= REPEATS - empty and (empty or any(c.isalpha() for c in part) and len(part) > 3):
            return True
    return False


def _is_dummy(words: list[str]) -> bool:
    """Words of dummy Latin: most are known ones, or a good part is and nothing makes a sentence of them."""
    known = sum(w in _LATIN for w in words)
    rare = sum(w in _LATIN and w not in _ORDINARY for w in words)
    return len(words) >= 6 and known >= 0.7 * len(words) and rare >= 4 or len(words) >= 5 and rare >= 2 and known >= 0.2 * len(words) and not any(w in _FUNCTION for w in words)


def _held_place(text: str) -> bool:
    """A line that consists of placeholder sentences or dummy words, apart from a few letters."""
    for line in lowered(text).split("\n"):
        words = [w.rstrip(";") for w in _WORD.findall(line)]
        if len(words) >= 3 and all(w in _JUNK for w in words) or _is_dummy(words):
            return True
        marks = bytearray(len(line))
        for end, (kind, size) in automaton().iter(line):
            if "filler" in kind:
                marks[end + 1 - size : end + 1] = b"\1" * size
        letters = [k for k, c in zip(marks, line, strict=True) if c.isalpha()]
        if letters and sum(letters) >= 0.8 * len(letters):
            return True
    return False


_COMMON = (" the ", " of ", " and ", " to ", " de ", " la ", " que ", " el ", " en ", " der ", " die ", " und ", " le ", " les ", " des ", " je ", " se ", " na ", " u ", " i ")


def _unreal(text: str) -> bool:
    """A line of running words that no sentence could do with: none of the common words, a few words over and over."""
    for line in text.split("\n"):
        if line.count(" ") < 11 or any(w in line for w in _COMMON) or not line.isascii() or any(c.isdigit() for c in line):
            continue
        words = _WORD.findall(line)
        if len(words) < 12 or sum(w[0].isupper() for w in words) > len(re.findall(r"[.!?]", line)) + 1:
            continue
        words = [w.lower() for w in words]
        if len(set(words)) <= 0.8 * len(words) and not any(w in _FUNCTION for w in words):
            return True
    return False


def is_filler(text: str, kinds: set[str]) -> bool:
    return _unreal(text) or _repeats(text, kinds) or "dummy" in kinds and _dummy_run(text) or bool(kinds & {"filler", "dummy"}) and _held_place(text)


def _plain(text: str) -> str:
    text = text.replace("’", "'")
    return _MARKUP.sub("\n", _UNSEEN.sub("\n", text)) if "<" in text else text


def _covered(low: str) -> tuple[bool, int, int]:
    """Of a line: whether a message or notice hits it, letters covered, letters that count."""
    marks, hit = bytearray(len(low)), False
    for m in _NEUTRAL.finditer(low):
        marks[m.start() : m.end()] = b"\2" * (m.end() - m.start())
    for end, (kind, size) in automaton().iter(low):
        if kind & {"message", "notice"}:
            marks[end + 1 - size : end + 1] = b"\1" * size
            hit = hit or size > 8
    for m in _FRAMES.finditer(low):
        marks[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    mine = own = at = 0
    for sentence in _ENDS.split(low) if hit else [low]:
        letters = [k for k, c in zip(marks[at : at + len(sentence)], sentence, strict=True) if c.isalpha()]
        at += len(sentence)
        counted, found = sum(k != 2 for k in letters), sum(k == 1 for k in letters)
        mine, own = mine + (counted if found >= OWN * counted else found), own + counted
    return hit, mine, own


def is_message(text: str) -> bool:
    """The page consists of messages only, apart from markup, menus, headline and footer."""
    plain = _plain(text)
    low = lowered(plain)
    # What messages can cover at most: once more letters than that allows are seen, the rest can't help.
    most = sum(size for _, (kind, size) in automaton().iter(low) if kind & {"message", "notice"}) / OWN + sum(_length(low, m) for m in _FRAME_STARTS.finditer(low))
    found = total = kept = 0
    strong, headline = False, None
    for line in map(str.strip, plain.split("\n")):
        if not line or _BOILER.search(line):
            continue
        if COVERED * total > most:
            return False
        kept += 1
        hit, mine, own = _covered(lowered(line))
        if not hit and own and kept == 1 and not re.search(r"[.!?:;…]$|[.!?]\s", line):
            headline = (mine, own)
            continue
        strong = strong or hit
        found, total = found + mine, total + own
    if headline is not None and kept == 1:
        found, total = headline
    return strong and (total == 0 or found >= COVERED * total)


def _length(low: str, m: re.Match) -> int:
    """Letters that a message around a name can cover at most: the rest of its line."""
    end = low.find("\n", m.start())
    return (end if end >= 0 else len(low)) - m.start()


def residue(text: str | None) -> str | None:
    """slot, filler or message; None for real content and for null, empty and blank texts."""
    if text is None or not text.strip():
        return None
    places: dict[str, list[int]] = {"slot": [], "note": []}
    kinds: set[str] = set()
    for end, (its, size) in automaton().iter(lowered(text)):
        kinds |= its
        for kind in ("slot", "note"):
            if kind in its:
                places[kind].append(end + 1 - size)
    if places["slot"] and open_slot(text, places["slot"]) or places["note"] and open_note(text, places["note"]) or "_" in text and leaked_names(text):
        return "slot"
    if is_filler(text, kinds):
        return "filler"
    if ("message" in kinds or "notice" in kinds) and is_message(text):
        return "message"
    return None


def judged(documents: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` of all documents and residue: slot, filler, message, or null for real content.

    Rows are judged where they are read, without a shuffle. Null, empty and blank texts have no residue.
    """
    slim = documents.select(*columns, F.col(text).alias("_text"))
    schema = ", ".join([*(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in columns), "residue string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = pa.array([residue(t) for t in batch.column(len(columns)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], told], names=[*columns, "residue"])

    return slim.mapInArrow(run, schema)


def find_residue(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Columns key and residue of the affected documents, one row for each; repeated rows come out repeatedly."""
    return judged(documents.where(F.col(text).rlike(r"\S")), [key], text).where("residue is not null")
