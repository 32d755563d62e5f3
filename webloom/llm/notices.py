"""Words of error pages, script notices and filler, learnt from a labelled table that this module writes itself.

training_pages() builds labelled bodies of lines from parts (what is missing, what happened, what the reader shall do) in the
languages of the crawl, and as many bodies of ordinary short lines, some with the same words. From these come the log
odds of each word's stem (naive Bayes) and the decision trees over them that give a template its verdict.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np

from webloom.llm.language import FUNCTION_WORDS
from webloom.llm.tree import Tree

WORD = re.compile(r"[^\W\d_]+")
#: Letters of a stem, log odds of a stem the table lacks, greatest log odds of one stem, and the share of stems that
#: are hidden from the trees' training, so that they learn to do without some of them.
STEM, UNKNOWN, MOST, HIDDEN = 5, -0.9, 4.0, 0.2
#: Masks by type: a template keeps the type of what it hides.
MASKS = (
    ("<long>", re.compile(r"^.{200}")),
    ("<url>", re.compile(r"(?:https?://|www\.)\S+")),
    ("<trace>", re.compile(r"^\(?[\w./\\$-]*\w\.\w{1,5}:\d+\)?[:,]?$|^[\w.$<>]+\([\w.]+:\d+\)$|^\"?[\w/\\.-]+\.(?:py|php|js|rb|java|cs|pl)\"?,?$")),
    ("<exception>", re.compile(r"^(?:[a-z_]\w*\.)*\w+(?:error|exception|fault)(?:[:(]\S*)?$")),
    ("<path>", re.compile(r"^[\"'(]?/[\w./-]+[\"'),:]*$")),
    ("<code>", re.compile(r"^\W*[45]\d\d\W*$")),
    ("<time>", re.compile(r"^\W*(?:\d{1,2}[:.]\d\d(?:[:.]\d\d)?|\d{1,4}[-./]\d{1,2}[-./]\d{1,4})\W*\w?$")),
    ("<id>", re.compile(r"^\W*(?=\S*\d)(?=\S*[a-z])[\w-]{5,}\W*$|^\W*0x[0-9a-f]+\W*$|^\w*sqlstate\S*$")),
    ("<num>", re.compile(r"^\W*\d[\d.,]*\W*$")),
    ("<mash>", re.compile(r"^\W*(?:(\w)\1{2,}|[asdfjkl]{3,}|qwe\w*|zxcv\w*)\W*$")),
)
TYPES = tuple(name for name, _ in MASKS)


def mask(token: str) -> str:
    """A lower-case token, or its type where it is a number, an address, a place in a program, overlong and the like."""
    for name, pattern in MASKS:
        if pattern.search(token):
            return name
    return token


def tokens(text: str) -> list[str]:
    """Masked tokens of a message; signs that stand alone are left out."""
    got = [mask(t) for t in text.lower().split() if any(c.isalnum() for c in t) or t == "*"]
    return got or ["<sign>"]


def stems(parts: list[str]) -> list[str]:
    return [p if p in TYPES else w[:STEM] for p in parts for w in ([p] if p in TYPES else WORD.findall(p))]


# ---- the labelled table -------------------------------------------------------------------------------------

#: Parts of notices by language: (what, what is wrong with it). Each what goes with each wrong.
_GONE = {
    "en": ("page|file|document|address|resource|link|content|article|url|item|site|record|page you asked for|page you requested|page you are looking for|requested page|requested url|requested address|content you want|listing|that page|this page|that link|the file".split("|"), "not found|could not be found|cannot be found|can't be found|was not found|cannot be displayed|does not exist|no longer exists|doesn't exist any more|is missing|has been removed|has moved|is not available|is unavailable|is broken|is gone|was deleted|has expired|leads nowhere|could not be loaded|is not available in your region|is no longer here".split("|")),
    "fr": ("la page|le fichier|cette page|le document|cette adresse|le lien|la page demandée|le contenu".split("|"), "est introuvable|introuvable|n’existe pas|n’existe plus|n’a pas été trouvée|n’est pas disponible|a été supprimée|ne mène nulle part|est indisponible|a expiré".split("|")),
    "de": ("die seite|diese seite|die datei|das dokument|diese adresse|der link|die angeforderte seite|der inhalt".split("|"), "wurde nicht gefunden|nicht gefunden|konnte nicht gefunden werden|existiert nicht|gibt es nicht mehr|ist nicht verfügbar|ist nicht erreichbar|wurde gelöscht|ist abgelaufen|führt nirgendwohin".split("|")),
    "es": ("la página|esta página|el archivo|el documento|esta dirección|el enlace|la página solicitada|el contenido".split("|"), "no se encuentra|no encontrada|no existe|ya no existe|no se ha encontrado|no está disponible|ha sido eliminada|ha caducado|no lleva a ninguna parte".split("|")),
    "pt": ("a página|esta página|o arquivo|o documento|este endereço|a ligação|o conteúdo".split("|"), "não foi encontrada|não encontrada|não existe|já não existe|não está disponível|foi removida|está indisponível|expirou".split("|")),
    "pl": ("strona|ta strona|plik|dokument|ten adres|odnośnik|żądana strona".split("|"), "nie została znaleziona|nie znaleziono|nie istnieje|już nie istnieje|jest niedostępna|została usunięta|wygasła".split("|")),
    "ru": ("страница|эта страница|файл|документ|этот адрес|ссылка|запрошенная страница".split("|"), "не найдена|не существует|больше не существует|недоступна|удалена|не найден|устарела".split("|")),
}
_REFUSED = "access denied|access to this page was denied|permission denied|forbidden|unauthorized|you are not allowed to see this|you do not have permission to view this page|your session has expired|please log in again|login required|sign in to continue|this account has been suspended|your account is blocked|too many requests|too many requests from your address|you have sent too many requests|many requests from this network|unusual traffic from your network|your address has been blocked|rate limit exceeded|internal server error|something went wrong|an error occurred|an unexpected error occurred|oops|bad gateway|bad request|gateway timeout|service unavailable|the service is temporarily unavailable|server error|the server encountered an error|the server did not reply|upstream host gave no answer|connection timed out|connection refused|error establishing a database connection|could not connect to the database|down for maintenance|we are under maintenance|scheduled maintenance|please try again later|try again in a few minutes|we could not process your request|request failed|http error|http status|error code|status code|fatal error|unhandled exception|stack trace|segmentation fault|core dumped|warning undefined variable|undefined function called|call to undefined method|failed to open stream|traceback most recent call last|no such file|line in file|caused by|out of memory|sorry this is our fault|we looked but found nothing here|nothing here|no results|gone|accès refusé|accès interdit|erreur du serveur|erreur interne|votre session a expiré|maintenance en cours|service indisponible|veuillez réessayer plus tard|zugriff verweigert|zugriff gesperrt|interner serverfehler|ein fehler ist aufgetreten|ihre sitzung ist abgelaufen|wartungsarbeiten|bitte versuchen sie es später|acceso denegado|error del servidor|error interno|su sesión ha caducado|en mantenimiento|inténtelo más tarde|acesso negado|erro interno|a sua sessão expirou|em manutenção|tente mais tarde|brak dostępu|odmowa dostępu|błąd serwera|sesja wygasła|spróbuj później|trwa konserwacja|доступ запрещен|доступ закрыт|ошибка сервера|сессия истекла|попробуйте позже|технические работы".split("|")
_SCRIPTS = {
    "en": ("javascript|scripts|scripting|cookies and scripts|scripts and cookies|javascript support".split("|"), "please enable {} to view this page|you need to enable {} to run this app|this site requires {}|this page needs {}|{} is disabled in your browser|{} is turned off|{} must be on|your browser does not run {}|your browser blocks {}|turn on {} and reload|allow {} for this site|without {} the content cannot be shown|this site works best with {} turned on|change your settings to allow {}|{} required|loading if nothing happens enable {}|checking your browser {} needed|verify that you are a human with {}|please activate {}|switch on {} in the settings of your browser".split("|")),
    "fr": ("javascript|les scripts".split("|"), "veuillez activer {} pour continuer|ce site nécessite {}|votre navigateur bloque {}|{} est désactivé dans votre navigateur|sans {} la page ne peut pas s’afficher|activez {}".split("|")),
    "de": ("javascript|skripte".split("|"), "bitte aktivieren sie {} um diese seite zu sehen|diese seite benötigt {}|ihr browser blockiert {}|{} ist deaktiviert|ohne {} kann der inhalt nicht angezeigt werden|schalten sie {} ein".split("|")),
    "es": ("javascript|los scripts".split("|"), "active {} para ver esta página|este sitio necesita {}|su navegador no permite {}|{} está desactivado|sin {} no se puede mostrar el contenido|habilite {}".split("|")),
    "pt": ("javascript|os scripts".split("|"), "ative {} para ver esta página|este site precisa de {}|seu navegador bloqueia {}|sem {} não se pode mostrar o conteúdo|habilite {}".split("|")),
    "pl": ("javascript|skrypty".split("|"), "włącz {} aby zobaczyć stronę|ta strona wymaga {}|przeglądarka blokuje {}|bez {} nie można pokazać treści".split("|")),
    "ru": ("javascript|скрипты".split("|"), "включите {} чтобы увидеть страницу|этот сайт требует {}|ваш браузер блокирует {}|без {} содержимое не показать".split("|")),
}
_FILLER = "your {} goes here|{} goes here|this is a sample {}|sample {}|example {}|dummy {}|dummy {} for layout only|placeholder {}|placeholder for {}|please replace this {}|add your own {}|add {} here|enter your {}|type your {}|write your {} here|insert {} here|click to edit {}|short description of the {}|untitled {}|new {}|demo {}|lorem ipsum {}".split("|")
_FILLED = "text|heading|headline|title|content|paragraph|copy|image|page|document|block|caption|description|name|subtitle|product|text in this block|content in this block|heading two".split("|")
_FILLER_ELSE = "tbd|tba|todo|coming soon|under construction|test|test test|test page|test test 123|xxx|xxx xxx xxx|xxx test|asdf|asdf asdf qwer|asdf jkl asdf|asdf jkl qwer|qwerty|hello world|just another site|texte provisoire|texte d’exemple|texte à remplacer|contenu provisoire|titre d’exemple|ici vient le texte|hier steht später ein text|hier kommt text hin|beispieltext|platzhalter|blindtext|mustertext|überschrift einfügen|texto de ejemplo|texto de prueba|texto de relleno|aquí va el texto|escriba su título|texto de exemplo|aqui vai o texto|przykładowy tekst|tekst zastępczy|tu będzie tekst|здесь будет текст|пример текста|текст для примера".split("|")
_HELPER = "try our search|use the search|back to the start page|go to the home page|go back|return to the front page|contact us|contact support|contact the webmaster|if you think this is a mistake tell the webmaster|check the spelling of the address|check the address|please check the address and try again|request id <id>|reference <id>|ticket <id>|ray id <id>|incident <id>|error code <num>|code <num>|time <time>|date <time>|title|home|retour à l’accueil|vérifiez l’adresse|zurück zur startseite|prüfen sie die adresse|volver al inicio|compruebe la dirección|voltar ao início|verifique o endereço|powrót do strony głównej|sprawdź adres|на главную|проверьте адрес".split("|")
_TRACES = "traceback most recent call last|<trace> line <num> in main|at <trace>|<exception>|<exception> not set|caused by <exception>|warning <trace>|fatal error uncaught <exception> in <trace>|parse error on line <num>|notice undefined index in <path> on line <num>|<exception> at <path>|exception in thread main <exception>|<code>|error <code>|http <code>|error <num>|status <code>|<code> error|fehler <code>|erreur <code>|error <code> not found|#<num> <path> <trace>|<id> general error|segmentation fault".split("|")
#: Ordinary short lines; {} stands for an invented name, # for a number.
_ORDINARY = "by {} {}|text and pictures {} {}|last updated #|updated on # at #|published # by {}|{}|{} {}|{} and the red door|the local library of {}|notes from the garden in {}|why {} changed its market|{} # km|# g of fine {}|# cups of {}|{} # volts|{} <time> #|# days at the station of {}|a quick letter for {}|the annual report of {}|cheap {} lamp|best {}|buy {} online|{} size #|{} hotel|sale {}|old town|river|in winter|questions|sources|results|how it began|the way back|no one bought the shy lake|it was hot|the dog ran home|we came too late|the door would not open|he could not find the road|the boat was gone|they found the file in a drawer|a page of the old book was missing|the address was on the letter|the school requires a uniform|the bridge was closed for maintenance for # weeks|the mill no longer exists|please bring your own cup|turn on the oven|allow it to rest for # minutes|the server brought the soup|she tried again later|the session lasted # hours|the text was written in #|the title was hers|your ticket is valid for # days|the café is not available on mondays|opening hours # to #|members only|entry is free|wet paint|mind the step|parking # euros|la bibliothèque de {}|le vieux moulin|l’école du village|mis à jour le #|die bücherei in {}|der höhenweg|aktualisiert am #|von {} {}|la casa de {}|una tarde en el río|actualizado el #|o armazém de {}|a canção do rio|atualizado em #|stara biblioteka|łódź rybacka|autor {} {}|старая библиотека|школа у реки|автор {} {}|береговая служба {}|{} {} {}|{} # {}|# {}|* {}|menu of the week|soup and bread|main line to {}|platform # {}|sunday <time>|tickets from #|the story so far|a test of patience|the sample was taken in {}|the copy hangs in the museum|her own heading|the document lies in the archive|the link between {} and {}|an error of the pilot|the text is an example of how it is written|this is an example of the way a page is made|a sample of such a text stands in the archive|how such a page is written|the title of the page was written by {}|an example of good writing|this text tells of {}|the description is that of a mill|her text is a good example|the content of the box was sold|it is a page of the diary of {}|here goes the road to {}|the request of the council".split("|")
_LATIN, _VOWELS = "bcdfghjklmnprstvwz", "aeiou"


def _name(rng: random.Random) -> str:
    return "".join(rng.choice(_LATIN) + rng.choice(_VOWELS) for _ in range(rng.randint(2, 4))) + rng.choice(["", "n", "ck", "rd", "m"])


def training_pages(pages: int = 2400, seed: int = 3) -> list[list[tuple[str, str]]]:
    """Bodies as (line, class) with class bad, helper or none; every other body is a case. `pages` bounds the table."""
    rng = random.Random(seed)

    def gone() -> str:
        what, wrong = _GONE[rng.choice(list(_GONE) + ["en"] * 6)]
        return f"{rng.choice(what)} {rng.choice(wrong)}"

    def scripts() -> str:
        what, forms = _SCRIPTS[rng.choice(list(_SCRIPTS) + ["en"] * 4)]
        return rng.choice(forms).format(rng.choice(what))

    def refused() -> str:
        return rng.choice(_REFUSED)

    def trace() -> str:
        return rng.choice(_TRACES)

    def filler() -> str:
        return rng.choice(_FILLER).format(rng.choice(_FILLED)) if rng.random() < 0.6 else rng.choice(_FILLER_ELSE)

    def ordinary() -> str:
        if rng.random() < 0.4:
            words = FUNCTION_WORDS[rng.choice(list(FUNCTION_WORDS))].split()
            return " ".join(rng.choice(words) if rng.random() < 0.5 else _name(rng) for _ in range(rng.randint(2, 16)))
        return re.sub(r"\{\}", lambda _: _name(rng), rng.choice(_ORDINARY)).replace("#", rng.choice(["<num>", "<num>", "<num>", "<code>"]))

    out = []
    for k in range(pages):
        if k % 2:
            out.append([(ordinary(), "none") for _ in range(rng.randint(1, 10))])
            continue
        make = rng.choice((gone, gone, refused, refused, scripts, scripts, trace, filler, filler))
        body = []
        for _ in range(rng.choice([1, 1, 1, 2, 3, 4])):
            line, more = make(), rng.random()
            if make in (gone, refused) and more < 0.15:
                line = f"<code> {line}" if more < 0.08 else f"error <code> {line}"
            elif more < 0.3:
                line += f" {rng.choice(['please', 'sorry', 'oops'])} {make()}" if more < 0.22 else f" {rng.choice([_name(rng), rng.choice(_HELPER)])}"
            body.append((line, "bad"))
        if rng.random() < 0.4:
            body.append((rng.choice(_HELPER), "helper"))
        if rng.random() < 0.2:
            body.insert(0, (ordinary(), "none"))
        out.append(body)
    return out


class Notices:
    """Log odds of stems and the trees that judge a template by them."""

    def __init__(self, pages: int = 2400):
        bodies = [[(stems(tokens(line)), c) for line, c in body] for body in training_pages(pages)]
        table = [x for body in bodies for x in body]
        seen = {c: Counter(w for s, k in table if k == c for w in set(s)) for c in ("bad", "helper", "none")}
        self.odds: dict[str, dict[str, float]] = {}
        for c, other in (("bad", seen["none"]), ("helper", seen["none"] + seen["bad"])):
            a, n, m = seen[c], sum(seen[c].values()), sum(other.values())
            # a stem seen once is a name or as good as unknown
            self.odds[c] = {w: max(-MOST, min(MOST, math.log((a[w] + 0.5) / n) - math.log((other[w] + 0.5) / m))) for w in a | other if a[w] + other[w] > 1}
        rng = random.Random(pages)
        x, y = [], []
        for body in bodies:
            body = [([w if rng.random() >= HIDDEN else "?" for w in s], c) for s, c in body]
            company = self.company([s for s, _ in body])
            x += [self.features(s, company) for s, _ in body]
            y += [c for _, c in body]
        self.trees = {c: Tree(depth=7, leaf=8).fit(np.array(x), np.array([k == c for k in y])) for c in ("bad", "helper")}

    def looks(self, words: list[str]) -> float:
        """Mean log odds of being bad."""
        return sum(self.odds["bad"].get(w, UNKNOWN) for w in words) / max(1, len(words))

    def company(self, lines: list[list[str]]) -> float:
        """Share of a body's words that stand in lines which look bad by their words alone."""
        return sum(len(s) for s in lines if self.looks(s) > 0) / max(1, sum(len(s) for s in lines))

    def features(self, words: list[str], company: float) -> list[float]:
        """Mean, sum and greatest log odds of being bad, mean of being helper, unknown share, length, types hidden, and
        the company a template keeps: what else stands in the bodies that hold it."""
        n = max(1, len(words))
        bad = [self.odds["bad"].get(w, UNKNOWN) for w in words]
        helper = [self.odds["helper"].get(w, UNKNOWN) for w in words]
        known = sum(w in self.odds["bad"] for w in words)
        masks = [sum(w == t for w in words) / n for t in ("<trace>", "<exception>", "<code>", "<num>", "<time>", "<id>", "<mash>")]
        return [sum(bad) / n, sum(bad), max(bad, default=0.0), sum(helper) / n, 1 - known / n, min(n, 12), *masks, company]

    def verdicts(self, templates: list[list[str]], company: list[float]) -> list[str | None]:
        """bad, helper or None for each template (its masked tokens), given the mean company of its lines."""
        if not templates:
            return []
        x = np.array([self.features(stems(t), s) for t, s in zip(templates, company, strict=True)])
        bad, helper = (self.trees[c].predict(x) >= 0.5 for c in ("bad", "helper"))
        return ["bad" if b else "helper" if h else None for b, h in zip(bad.tolist(), helper.tolist(), strict=True)]


@lru_cache(1)
def notices(pages: int = 2400) -> Notices:
    return Notices(pages)
