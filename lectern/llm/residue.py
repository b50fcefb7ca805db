"""P8: template residue, filler, error pages and script notices in place of content.

A document is reported for the first of these reasons that holds:

* ``placeholder`` - a delimiter grammar matches an unfilled placeholder where a value should stand.
  Code blocks, lines of code and names that the surrounding language defines (environment
  variables, markup tags, sounds in transcripts, wiki links) are passed over. So are mentions: a quoted
  placeholder, one in a sentence that speaks about notation, or one in a tutorial, a text in which
  the words of notation are dense.
* ``filler`` - stock phrases of dummy text, keyboard rows or one phrase repeated cover most of a
  sentence, or it is pseudo-Latin, nearly without the function words of a living language.
* ``error`` / ``scripts`` - every sentence is put down as a notice, as page furniture, as the voice of a
  page (it asks to reload, to go back, to sign in) or as content. The text is such a page if it holds a
  notice and the words of content are few beside those of its notices. A sentence is a notice by its
  shape: a status line, that is a code or status phrase which covers most of it; a page, server or file
  with a predicate of failure; a script word with a verb of need or absence. A narrated sentence, one
  with a past tense beyond those a notice takes, is content. Words of Chinese and Japanese are
  counted as two characters each.

Every document is read whole, in one pass without a shuffle; sentences of any length are judged alike.

Defined results: NULL and empty texts are not reported; NULL ids are reported with a NULL id; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property
from operator import eq

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.functions.words import words_of

I = re.IGNORECASE  # noqa: E741


def _any(words: str) -> str:
    """An alternation of words written one after another; '_' stands for a blank."""
    return "(?:" + "|".join(w.replace("_", " ") for w in words.split()) + ")"


# ---- placeholders --------------------------------------------------------------------------------

_NAME = r"[^\W\d_][\w.\- ]{0,60}"
_SOUND = _any("breath breathing noise laugh laughs laughter cough coughs unk unknown sil silence sp spk spn music click sigh inaudible unintelligible crosstalk hesitation pause applause lipsmack smack sneeze um uh foreign overlap eos bos pad mask")
_TAG = _any("html head body title div span p br hr a b i u em strong code pre table tr td th thead tbody ul ol li dl dt dd img script style link meta form input label button select option h1 h2 h3 h4 h5 h6 nav header footer section article aside main figure iframe svg path sup sub")
_ENV = _any("HOME PATH USER USERNAME SHELL PWD TMP TEMP TMPDIR LANG EDITOR HOSTNAME APPDATA LOCALAPPDATA PROGRAMFILES PROGRAMDATA USERPROFILE WINDIR SYSTEMROOT COMSPEC JAVA_HOME PYTHONPATH")
#: What a field of a form or letter is called.
_FIELD = _any("name names date dates title address e-?mail phone number no company city country amount price total order customer client user username recipient sender subject topic company_name street zip code position role department link url id text here value speaker accent language room session reviewer version")
#: One grammar a delimiter. Groups: soft - counts where a value should stand only.
PLACEHOLDER = re.compile(
    r"[\[{$#%<&@_*](?:"
    rf"(?<=\{{)\{{\s*[#/^&]?\s*{_NAME}(?:\|[^{{}}]*)?\s*\}}?\}}\}}"  # {{name}}
    rf"|(?<=\$)\{{\s*(?!{_ENV}\b){_NAME}(?::-[^{{}}]*)?\}}"  # ${name}
    rf"|(?<=#)\{{\s*{_NAME}\}}"  # #{name}
    rf"|(?<=\{{)%-?\s*\w+[^%]{{0,80}}%\}}"  # {% block name %}
    rf"|(?<=\{{)(?!{_SOUND}\}})(?:[^\W\d_]\w{{1,40}}|\d{{1,2}})\}}(?!\}})"  # {name}, {0}
    rf"|(?<=<)%=?\s*{_NAME}\s*%>"  # <%= name %>
    rf"|(?<=<)(?i:insert|enter|your|add)\s{_NAME}>"  # <insert name>
    rf"|(?<=<)(?!(?i:{_TAG})>)[A-Z][A-Z0-9]{{1,30}}(?:_[A-Z0-9]+)*>"  # <NAME>
    rf"|(?<=&)lt;\s*(?!(?:{_SOUND}|{_TAG})&){_NAME}&gt;"  # &lt;name&gt;
    r"|(?<=\[)\[\s*[a-z][\w.\- ]{0,60}\]\]"  # [[name]]; a capital is a wiki link
    rf"|(?<=\[)(?:(?i:insert|enter|add|your)\s+{_NAME}|{_NAME}\s(?i:to be filled in|goes here|here))\]"  # [INSERT NAME HERE]
    r"|(?<=%)\(\w{1,40}\)[sdrf]"  # %(name)s
    rf"|(?<=%)(?!{_ENV}%)%?[A-Z][A-Z0-9_]{{1,40}}%"  # %NAME%
    r"|(?<=\$)[A-Z][A-Z0-9_]{1,40}\$"  # $NAME$
    r"|(?<=@)@[A-Za-z][\w\-]{0,40}@@"  # @@name@@
    r"|(?<=#)#[A-Za-z][\w\-]{0,40}##(?!#)"  # ##name##
    r"|(?<=\*)\|[A-Z][\w:]{0,40}\|\*"  # *|NAME|*
    r"|(?<=_)_[A-Z][A-Z0-9]{0,20}(?:_[A-Z0-9]+)*__(?!_)"  # __NAME__
    rf"|(?<=_)_(?!name__)(?:[a-z0-9]+_)*{_FIELD}__(?!_)"  # __first_name__
    rf"|(?<=[<\[])(?P<soft>(?!{_SOUND}[>\]])(?:[A-Za-z]+[ _\-]){{0,3}}(?i:{_FIELD}))[>\]]"  # [Order Number], <name>
    r")"
)
#: A label with an empty value, on a line of its own.
_EMPTY_FIELD = re.compile(r"^[ \t]*[^\W\d_][\w ]{1,30}:[ \t]*(?:TBD|TBA|TODO|X{3,}|_{3,}|\.{4,}|\[[ \t]*\])[ \t]*$", re.M)
#: Before a value: a salutation, a label, a preposition or article.
_VALUE = re.compile(r"(?:\b(?:dear|hello|hi|hey|greetings|liebe[rs]?|hallo|cher|chère|bonjour|estimad[oa]|querid[oa]|hola|by|for|from|to|of|on|at|in|your|our|mr|mrs|ms|dr|is|was|order|number|version|signed)\.?|[:,(])\s*$", I)
_SOFT_FIELD = re.compile(rf"[ _\-]|^{_FIELD}$", I)
_OPEN, _CLOSE = "`'\"“‘«„‹‚", "`'\"”’»“›‘"
#: Words of notation.
_NOTATION = re.compile(
    r"\b(?:stands? for|denotes?|means|represents|parser|parses|parsed|syntax|placeholders?|templat\w+|variables?|literals?|delimiters?|curly (?:braces?|brackets?)|macros?|interpolat\w+|substitut\w+|expand(?:s|ed) to|is (?:replaced|written|rendered|expanded|spelled)|are (?:replaced|written|rendered|expanded)|wik[it]\w*|such as|for example)\b|\be\.g\.|\blet\b.{0,12}\bbe\b",
    I,
)
_TUTORIAL = re.compile(r"\b(?:templat\w+|syntax|placeholders?|variables?|jinja\w*|mustache|handlebars|liquid|tutorial|snippets?|curly (?:braces?|brackets?)|delimiters?|render\w*|loops?|filters?)\b", I)
_CODE = re.compile(r"```.*?(?:```|\Z)|<(pre|code)\b[^>]*>.*?</\1>|^(?: {4}|\t)\S.*$", re.S | re.M | I)
#: A line of code without a fence.
_CODE_LINE = re.compile(
    r"^[ \t]*(?:[$>#] ?)?(?-i:echo|export|cd|sudo|source|printf|mkdir|rm|cp|mv|curl|git|pip|npm|import|def|function|var|const|public|private|static)\b.*[;={}()/$].*$"
    r"|^.*(?:(?<!&gt);|\)\s*\{|=>|->|==|\+=|:=)[ \t]*$|^[ \t]*[A-Za-z_]\w*[ \t]+=[ \t]+\S.*$",
    re.M | I,
)


def _sentence_around(text: str, a: int, b: int) -> tuple[int, int]:
    begin = max(text.rfind("\n", 0, a), max(text.rfind(x, 0, a) for x in (". ", "! ", "? "))) + 1
    ends = [e for x in ("\n", ". ", "! ", "? ") if (e := text.find(x, b)) >= 0]
    return begin, min(ends, default=len(text))


def _placeholder(text: str) -> bool:
    hit = PLACEHOLDER.search(text)
    if not hit and not (":" in text and _EMPTY_FIELD.search(text)):
        return False
    bare = _CODE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    tutorial = None
    found = list(PLACEHOLDER.finditer(bare, max(0, hit.start() - 2))) if hit else []
    for k, m in enumerate(found):
        a, b = m.span()
        # placeholders side by side are quoted together
        first = last = k
        while first and found[first - 1].end() == found[first].start():
            first -= 1
        while last + 1 < len(found) and found[last].end() == found[last + 1].start():
            last += 1
        left, right = found[first].start(), found[last].end()
        if left and right < len(bare) and bare[left - 1] in _OPEN and bare[right] in _CLOSE:
            continue
        begin, end = _sentence_around(bare, a, b)
        before, rest = bare[begin:a], bare[b:end]
        if m["soft"] is not None and not (_SOFT_FIELD.search(m["soft"]) and (_VALUE.search(before) or not before.strip())):
            continue
        line = bare[bare.rfind("\n", 0, a) + 1 : (bare.find("\n", b) + 1 or len(bare) + 1) - 1]
        if _NOTATION.search(f"{before} X {rest}") or _CODE_LINE.match(line):
            continue
        if tutorial is None:  # the words of notation are dense: one in forty words, two at least
            n = len(_TUTORIAL.findall(bare))
            tutorial = n >= 2 and 40 * n >= bare.count(" ") + bare.count("\n")
        if not tutorial:
            return True
    return ":" in bare and bool(_EMPTY_FIELD.search(bare))


# ---- filler --------------------------------------------------------------------------------------

_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua aliquam enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum nam vestibulum mauris".split()
)
_LIVING = frozenset(
    "the a an of and was were is are to for with that this which we you they it he she on at from by not be has had about full und der die das ein eine ist mit für nicht le les un une des est et pour avec el los las del es para con que".split()
)
_KEYS = r"(?:(?:qwer|asdf|zxcv|sdfg|dfgh|fghj|ghjk|hjkl|xcvb|cvbn|vbnm|poiu|lkjh|jkl)[a-z]{0,8})"
_STOCK = re.compile(
    r"(?:this is |here is |some )?(?:a |an |the |just )?(?:sample|dummy|place ?holder|filler|example|lorem|blind|nonsense)s? (?:text|copy|content|sentence|paragraph|description|title|body)s?\b(?: \w+){0,8}"
    r"|(?:please )?(?:insert|add|enter|type|put|write|paste|replace)(?: (?:your|the|this|some|a|with)){0,2} ?(?:own )?(?:text|copy|content|description|paragraph|title|body|sentence|heading|caption|name)s?\b(?: \w+){0,6}"
    r"|(?:your|the|body|main) (?:text|content|description|title) (?:goes |comes |will (?:go|be) |appears )?here"
    rf"|{_KEYS}(?: {_KEYS})+"
    r"|(?:hier (?:steht|kommt|folgt|erscheint)|dies ist (?:ein )?(?:blindtext|platzhalter|mustertext|beispieltext)|blindtext|platzhalter(?:text)?|mustertext)(?: \w+){0,5}"
    r"|(?:ceci est un )?(?:texte|faux texte|contenu|phrase) (?:de remplissage|factice|d exemple|provisoire)(?: \w+){0,5}"
    r"|(?:este es un |esto es un )?(?:texto|contenido|frase) (?:de relleno|de ejemplo|de prueba|ficticio|provisional)(?: \w+){0,5}"
    r"|(?:questo è (?:un )?)?testo (?:segnaposto|di esempio|di prova|fittizio)(?: \w+){0,5}"
    r"|(?:este é um )?texto de (?:exemplo|preenchimento|teste)(?: \w+){0,5}"
    r"|(\w+(?: \w+)?)(?: \1){2,}(?: \d+)?",
    I,
)
#: In its presence a stock phrase is spoken of.
_SAID = re.compile(r"\b(?:said|told|asked|wrote|called|threw|found|kept|removed|deleted|replaced|sounds?|feels?|was full|were full|full of)\b", I)
_SENTENCE = re.compile(r"[\s。！？](?:(?<=[\n。！？])\s*|(?<=[.!?]\s)\s*(?=[^\s\d]|\d+\.?\s|\d{3}\b)|[-–•]\s+)")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def _is_filler(sentence: str) -> bool:
    ws = [w.lower() for w in _WORD.findall(sentence)]
    if not ws:
        return False
    if len(ws) >= 3 and len({w for w in ws if w in _LATIN}) >= 2 and 5 * sum(w in _LIVING for w in ws) <= len(ws):
        return True
    if sentence.lstrip()[:1] in _OPEN:
        return False
    if _SAID.search(sentence):
        return False
    plain = " ".join(ws).replace("'", " ").replace("’", " ")
    # stock phrases one after another; before the first, a heading of up to three words
    n, at, covered, skipped = plain.count(" ") + 1, 0, 0, 0
    while at < len(plain):
        m = _STOCK.match(plain, at)
        if m and (m.end() == len(plain) or plain[m.end()] == " "):
            covered += m.group().count(" ") + 1
            at = m.end() + 1
            continue
        skipped += 1
        if skipped > 3 or covered and skipped > 1:
            return False
        at = (plain.find(" ", at) + 1) or len(plain)
    return covered >= 2 and 5 * covered >= 3 * n


# ---- error pages and script notices --------------------------------------------------------------

_UI = _any("menu search log_?in login sign_in sign_up register home help about contact share print close next back privacy terms sitemap cookies imprint browse")
_FURNITURE = re.compile(
    rf"\bskip to (?:main )?content\b|\b{_UI}(?:[ |·/]+{_UI}){{2,}}\b|\b\w+(?: ?[|·›»] ?\w+){{2,}}|\bshare this \w+|©(?: ?(?:\d{{4}}|(?-i:[A-Z][\w&]*))){{1,3}}|\b(?:nginx|apache|cloudflare|iis|varnish)\b(?:/[\d.]+)?"
    r"|\b(?:cookie|privacy) policy\b|\ball rights reserved\.?"
    # what stands beside a failure only
    r"|(?P<trace>\b(?:request id|ray(?: id)?|reference|incident|trace id|correlation id)[: #]+[0-9a-f]*\d[0-9a-f]*\b"
    r"|\b(?:please )?(?:(?:go back|return) to (?:the |our )?(?:\w+ )?(?:page|site)|contact (?:the |our |your )?(?:\w+ )?(?:operator|administrator|admin|owner|support|webmaster)|try again(?: later| in \w+ \w+)?)\b\.?"
    r"|\b(?:bitte )?versuchen sie es (?:\w+ ){0,2}(?:erneut|noch einmal)\b\.?|\b(?:veuillez )?réessaye[rz](?: plus tard)?\b\.?|\binténtelo de nuevo(?: más tarde)?\b\.?|\briprova(?:re)? più tardi\b\.?|\btente novamente(?: mais tarde)?\b\.?)",
    I,
)
#: One of these, in lower case, is in whatever ``_FURNITURE`` matches.
_FURNITURE_PARTS = "skip_to | · › » © menu home share nginx apache cloudflare iis varnish request_id ray reference incident trace_id correlation policy rights_reserved search log_in login sign_in sign_up register help about contact print close next back privacy terms sitemap cookies imprint browse page site try_again versuchen réessaye inténtelo riprova novamente"

_STATUS_CODE = r"(?:4(?:0\d|1[0-8]|2[1-9]|31|51)|5(?:0\d|1[01]|2[0-6]))"
_LABEL = r"(?:http(?:/\d(?:\.\d)?)?|error|err|erro|errore|erreur|fehler|fel|fout|fejl|błąd|chyba|hiba|hata|virhe|ошибка|помилка|status|code|错误|錯誤|エラー|오류)"
#: Status phrases (fixed values of HTTP, and their usual renderings).
_STATUS = (
    r"(?:bad request|unauthori[sz]ed|payment required|(?:access )?forbidden|(?:page|file|document|resource|object|url)? ?not found|method not allowed|not acceptable|request time(?:d )?-?out|conflict|gone|payload too large|too many requests|internal (?:server )?error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time(?:d )?-?out|access denied|permission denied|session expired|connection (?:refused|reset|timed out|failed)|fatal error|unexpected error|application error|server error"
    r"|(?:seite |datei )?nicht gefunden|zugriff verweigert|interner (?:server)?fehler|dienst nicht verfügbar|(?:page |fichier )?introuvable|page non trouvée|accès (?:refusé|interdit)|erreur interne(?: du serveur)?|service indisponible|(?:página )?no encontrad[oa]|acceso denegado|error interno(?: del servidor)?|servicio no disponible"
    r"|(?:pagina )?non trovat[oa]|accesso negato|errore interno(?: del server)?|servizio non disponibile|(?:página )?não encontrad[oa]|acesso negado|erro interno(?: do servidor)?|serviço indisponível|(?:pagina )?niet gevonden|toegang geweigerd|interne serverfout|(?:sidan )?(?:kunde inte hittas|hittades inte)|åtkomst nekad|internt serverfel|(?:strona )?nie (?:została )?znaleziona?o?|odmowa dostępu|wewnętrzny błąd serwera"
    r"|(?:страница )?не найден[ао]?|доступ (?:запрещ[её]н|закрыт)|внутренняя ошибка(?: сервера)?|сервис недоступен|(?:页面|网页|頁面|文件)?(?:未找到|不存在|找不到)|找不到(?:页面|网页|頁面|文件)|拒绝访问|禁止访问|服务器(?:内部)?错误|服务不可用|(?:ページ|ファイル)が?(?:見つかりません|存在しません)(?:でした)?|アクセスが?拒否(?:されました)?|サーバー?(?:内部)?エラー)"
)
_STATUS_LINE = re.compile(rf"(?P<label>\b(?:{_LABEL}[\s:#\-–|]*)+)?(?:\b(?P<code>{_STATUS_CODE})\b[\s:(|\-–]*(?P<phrase>(?:{_STATUS})\b)?|(?<!\w)(?P<only>{_STATUS})(?!\w))[)\s.!]*", I)
_MARKED = re.compile(r"\s*[:|()–]|\s+-|-\s")
_THING = _any("page site website web_?page server servers service resource file document url uri link address request connection session account content item entry record recording clip video image transcript sheet table database backend gateway host domain application app player viewer browser tool store decoder proxy upstream api key certificate response query process system article post profile region it that")
_FAILS = (
    r"(?:(?:could|can|may|might|will)(?: ?not|n['’]t) (?:be )?(?:currently )?(?:found|shown|reached|read|handle|start|open|load|play|\w+ed)"
    r"|(?:is|was|are|were) (?:currently |temporarily |permanently |now )?(?:not (?:found|available|accessible|reachable|working|responding|allowed)|no longer \w+|unavailable|missing|down|overloaded|offline|gone|blocked|forbidden|restricted|disabled|closed|deleted|removed|renamed|moved|broken|invalid|unreachable|under maintenance)"
    r"|(?:has|have|had) (?:been )?(?:expired|ended|moved|timed out|failed|crashed|deleted|removed|blocked|disabled|renamed|suspended|closed)|may have (?:been )?\w+ed|does(?: ?not|n['’]t) (?:exist|respond|answer|load|work)|did(?: ?not|n['’]t) (?:respond|answer|load|work)"
    r"|timed out|refused the connection|failed to \w+|ran out of|crashed|hit an? (?:\w+ )?(?:exception|error)|(?:sent|returned|gave) an? (?:invalid|bad|empty|unexpected|incomplete)|met a condition|no longer (?:exists?|available|works?))"
)
_FAILURE = re.compile(
    rf"\b{_THING}\b(?:[^\w.!?]+[\w'’]+){{0,6}}?[^\w.!?]+{_FAILS}\b"
    rf"|\bsorry\b,?(?: but)?.{{0,60}}{_FAILS}\b"
    r"|\byou (?:do not|don['’]t) have (?:the |sufficient )?(?:permission|access|rights)|\byou (?:must|need to|have to) (?:be )?(?:log|sign|logged|signed)(?:ged)? ?in\b|\bsomething (?:broke|went wrong)|\ban? (?:\w+ )?(?:error|problem) (?:has )?(?:occurred|happened)"
    r"|\brate limit\b|\btoo many (?:requests|attempts)\b|\bno such (?:file|table|page)|\bunable to (?:connect|load|open|find|process|complete|reach|display)|\b(?:connection|request|query|authentication|upload|download) (?:failed|refused|reset|timed out|aborted)"
    r"|\btraceback \(most recent|\bunhandled exception|\bstack trace\b|\bsegmentation fault|\bdown for maintenance"
    r"|\b(?:aufnahme|seite|datei|adresse|dienst|server|sitzung)\b.{0,60}(?:gelöscht|entfernt|verschoben|nicht (?:gefunden|verfügbar|erreichbar)|existiert nicht|abgelaufen)|\bfehler beim\b|\bein fehler ist"
    r"|\b(?:page|enregistrement|fichier|adresse|service|serveur|session|document)\b.{0,60}(?:n['’]existe (?:plus|pas)|introuvable|indisponible|a été (?:supprimée?|déplacée?)|a expiré|ne répond)|\bune erreur (?:est|s['’]est)"
    r"|\b(?:página|grabación|archivo|servicio|servidor|sesión|documento|enlace)\b.{0,60}(?:no existe|ya no existe|no (?:está )?disponible|ha sido (?:eliminad|borrad|movid)[oa]|ha expirado|no se (?:pudo|puede|encuentra))|\bha ocurrido un error"
    r"|\b(?:pagina|sito|servizio|sessione|documento|collegamento)\b.{0,60}(?:non (?:esiste|è (?:più )?disponibile|è stat[ao] trovat[ao])|è stat[ao] (?:rimoss|spostat|eliminat)[ao]|scadut[ao])|\bsi è verificato un errore"
    r"|\b(?:página|site|serviço|servidor|sessão|arquivo|ficheiro)\b.{0,60}(?:não (?:existe|está disponível|foi (?:possível )?encontrad[oa])|foi (?:removid|movid|excluíd)[oa]|expirou)|\bocorreu um erro"
    r"|\b(?:pagina|website|dienst|sessie|bestand)\b.{0,60}(?:bestaat niet|niet (?:beschikbaar|gevonden)|is (?:verwijderd|verplaatst|verlopen))|\ber is een fout opgetreden"
    r"|\b(?:sidan|tjänsten|sessionen|filen)\b.{0,60}(?:finns inte|inte (?:tillgänglig|hittas)|har (?:tagits bort|flyttats|gått ut))|\bett fel (?:har )?(?:uppstod|inträffa)"
    r"|\b(?:strona|serwis|usługa|sesja|plik)\b.{0,60}(?:nie istnieje|niedostępn|został[ao]? (?:usunięt|przeniesion)|wygasł)|\bwystąpił błąd"
    r"|(?:страниц|сервис|сервер|файл|сесси|сайт)\w*.{0,60}(?:не (?:существует|найден|доступ|отвеча)|недоступ|удален|удалён|перемещ|истекл)|произошла ошибка"
    r"|(?:页面|網頁|网页|頁面|文件|链接|服务器?|会话).{0,20}(?:不存在|找不到|无法|已(?:被)?(?:删除|移动|过期)|不可用|出错)|(?:ページ|ファイル|サーバー?|セッション|リンク).{0,30}(?:見つかりません|存在しません|ありません|削除|移動|できません|切れ)|エラーが発生",
    I,
)
_FAILED = re.compile(rf"\b{_FAILS}\b", I)
_EXCEPTION = re.compile(r"^\s*(?:[\w.]+\.)?\w+(?:Error|Exception)\b(?::|$)|\b\w+(?:Error|Exception): |(?i:\btraceback \(most recent)")
_WEAK = re.compile(r"\W*(?:o+ps|who+ps|uh[ -]?oh|(?:we(?: are|['’]re) )?(?:so )?sorry|entschuldigung|désolé|lo sentimos|spiacenti|desculpe)\W*", I)
_MARKS = " \t\r-–•|>*#\ufeff\u00a0"
_CODE_ALONE = re.compile(rf"\W*{_STATUS_CODE}\W*")

_SCRIPT = r"(?:java[ -]?script|(?<![A-Za-z])js(?![A-Za-z])|\b(?:client-side |browser )?(?:scripts|scripting|script support)\b|\bskripte?n?\b|\bскрипт\w*|スクリプト|脚本)"
_NEEDS = (
    r"(?:enabl|activ|aktiv|ativ|attiv|abilit|habilit|włącz|включ|разреш|启用|啟用|开启|打开|有効|オン|필요|inschakel|ingeschakel|slå på|aktiver|einschalt|turn(?:ed)? on|switch(?:ed)? on|be on\b|allow|permit|requir|erforder|benötig|nécessit|requier|necesit|richied|richiest|requer|vereis|kräv|wymag|требу|需要|必要|\bneeds?\b|\bneeded|depends? on|relies on|work(?:s)? (?:properly |best )?(?:only )?with)"
)
_LACKS = (
    r"(?:disabl|deaktiv|désactiv|desactiv|disattiv|desativ|uitgeschakel|avaktiver|wyłącz|отключ|выключ|禁用|关闭|無効|オフ|turned off|switched off|(?:is|are|seems?) (?:currently )?off\b|block(?:ed|ing)|not (?:available|enabled|supported|running|detect)|does(?: not|n['’]t) (?:run|support)|could not detect|unavailable|without|\bno\b|\bsans\b|\bohne\b|\bsin\b|\bsenza\b|\bsem\b|\bzonder\b|\butan\b|\bbez\b|\bбез\b|没有|なし)"
)
_SCRIPTS = re.compile(rf"{_SCRIPT}.{{0,60}}?(?:{_NEEDS}|{_LACKS})|(?:{_NEEDS}|{_LACKS}).{{0,60}}?{_SCRIPT}|\bnoscript\b|\bchecking your browser\b", I)
_SHORT_SCRIPT = re.compile(rf"(?:\W*\w+){{0,3}}\W*{_SCRIPT}\W*\?", I)
_PERHAPS_SCRIPTS = re.compile("script|skript|js|скрипт|スクリプト|脚本|checking your", I)
#: What a page says beside its notice; it is neither notice nor content.
_VOICE = re.compile(
    r"\b(?:this |the |our |your |home ?|start ?|previous |web ?)?(?:page|site|browser|address|url|link|server|webmaster|administrator|operator|support|cookies|account)\b|\b(?:re-?load|refresh|go back|try again|retry|sign in|log in|come back|contact us|check back|search box|inconvenience|problem persists|lost your way|awkward|maintenance|redirected|settings|here|later|moved|deleted|on our (?:side|end)|error code|code)\b"
    r"|versuchen sie|erneut|zurück|startseite|réessayer|réessayez|retour|accueil|inténtelo|vuelva|inicio|riprova|torna|home ?page|tente novamente|volte|probeer|opnieuw|terug|försök|tillbaka|spróbuj|wróć|попробуйте|вернит|позже|请|稍后|返回|首页|お試し|戻|ください",
    I,
)
_PAST = re.compile(
    r"(?:(?P<by>[\w'’]+) )?\b(?P<verb>said|told|wrote|kept|came|went|knew|heard|threw|saw|took|gave|thought|felt|began|wanted|brought|bought|lost|held|stood|spoke|sent|used|had(?= (?:an?|the|no|to)\b)|\w{2,}ed)\b(?P<then> (?:an? (?:invalid|bad|empty|unexpected|incomplete)|(?:out|wrong)\b|the connection))?",
    I,
)
#: After these a participle is part of a notice's predicate; these verbs are so by themselves.
_AUXILIARY = frozenset("is are be been being was were has have had not currently temporarily permanently already or and you we longer an a the been unhandled being get got".split())
_NOTICE_VERBS = frozenset("renamed deleted removed failed timed occurred crashed expired ended refused denied required requested overloaded unhandled happened exceeded reached disabled blocked limited unauthorized need needed unexpected speed embed feed indeed exceed proceed red bed shared related".split())
_ABOUT = re.compile(r"\b(?:means|stands? for|for example|such as|refers to|is called)\b|\be\.g\.|[“\"«„‘'`][^”\"»’'`]{2,60}[”\"»’'`]\W", I)


def _n_words(sentence: str) -> int:
    """Words; two Chinese or Japanese characters are one."""
    if sentence.isascii():
        return len(words_of(sentence))
    wide = sum("぀" <= c <= "鿿" or "가" <= c <= "힯" for c in sentence)
    return (wide + 1) // 2 + len(_WORD.findall(re.sub("[぀-鿿가-힯]+", " ", sentence) if wide else sentence))


def _narrated(sentence: str) -> bool:
    for m in _PAST.finditer(sentence):
        if not m["then"] and m["verb"].lower() not in _NOTICE_VERBS and (m["by"] or "").lower() not in _AUXILIARY:
            return True
    return False


def _status_line(sentence: str, n: int) -> bool:
    """Whether a status code with a label, or a status phrase, makes up most of the sentence."""
    best, labelled = 0, False
    for m in _STATUS_LINE.finditer(sentence):
        line = m.group()
        code, phrase = m["code"], m["phrase"] or m["only"]
        marked = bool(code and (m["label"] or phrase or _MARKED.match(sentence, m.end("code"))))
        labelled |= marked
        if phrase or marked:
            best = max(best, _n_words(line))
    return 5 * best >= 3 * n > 0 or labelled and n <= 8


def _notice(sentence: str, n: int) -> str | None:
    """error, scripts or None."""
    if _EXCEPTION.search(sentence):
        return "error"
    if n > 3 and _narrated(sentence):
        return None
    if _PERHAPS_SCRIPTS.search(sentence) and (_SCRIPTS.search(sentence) or n <= 5 and _SHORT_SCRIPT.fullmatch(sentence)):
        kind = "scripts"
    elif _status_line(sentence, n):
        return "error"
    elif _FAILURE.search(sentence):
        kind = "error"
    else:
        return None
    return None if _ABOUT.search(sentence) else kind


#: What every notice, weak notice and filler sentence holds one of, in lower case.
_FILLS, _PAGES, _FURNISHED = 1, 2, 4
_STOCK_PARTS = "text cop content sentence paragraph description title bod heading caption name hier_ platzhalter contenu phrase contenido frase testo qwer asdf zxcv sdfg dfgh fghj ghjk hjkl xcvb cvbn vbnm poiu lkjh jkl"
_PAGE_PARTS = (
    "script skript js скрипт スクリプト 脚本 checking_your not cannot n't n’t unauthori forbidden payment conflict gone too_large too_many internal bad_request gateway unavailable denied expired refused reset failed fatal unexpected error exception time-out timeout timed missing down overloaded offline blocked restricted disabled closed deleted removed renamed moved broken invalid unreachable maintenance no_longer ended crashed suspended may_have ran_out hit_a sent_a returned_a gave_a met_a_condition permission logged log_in signed sign_in something problem rate_limit no_such unable_to traceback stack_trace segmentation"
    " nicht gelöscht entfernt verschoben abgelaufen fehler verweigert introuvable trouvée refusé interdit erreur indisponible existe supprim déplac expir répond encontrad denegado disponible eliminad borrad movid no_se_ trovat negato disponibile esiste rimoss spostat eliminat scadut negado erro indisponível não removid excluíd expirou gevonden geweigerd fout bestaat niet verwijderd verplaatst verlopen hitta nekad fel inte tillgänglig bort flyttats gått_ut znalezion odmowa błąd istnieje niedost usunięt przenie wygas"
    " не_ запрещ закрыт ошибк недоступ удал перемещ истек истёк 未找到 不存在 找不到 拒绝 禁止 错误 不可用 无法 已 出错 見つかりません 存在しません 拒否 エラー ありません 削除 移動 できません 切れ oops uh-oh uh_oh sorry request_id ray reference incident trace_id correlation try_again versuchen réessaye inténtelo riprova novamente go_back return_to contact entschuldigung désolé lo_sentimos spiacenti desculpe"
)


def _automaton() -> ahocorasick.Automaton:
    kinds: dict[str, int] = {}
    for kind, words in ((_FILLS, f"{_STOCK_PARTS} {' '.join(_LATIN)}"), (_PAGES, _PAGE_PARTS), (_FURNISHED, _FURNITURE_PARTS)):
        for w in words.split():
            w = w.replace("_", " ")
            kinds[w] = kinds.get(w, 0) | kind
    out = ahocorasick.Automaton()
    for w, kind in kinds.items():
        out.add_word(w, kind)
    out.make_automaton()
    return out


_PARTS = _automaton()
_CODES = re.compile(r"\b[45]\d\d\b")


class _Text:
    """A text, where it holds parts of the patterns, and its sentences (text, begin, end, whether there may be furniture)."""

    def __init__(self, text: str) -> None:
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer: places would not agree
            text = low
        self.text = text
        hits = list(_PARTS.iter(low))
        self.fills, self.pages, self.furnished = ([p for p, kinds in hits if kinds & kind] for kind in (_FILLS, _PAGES, _FURNISHED))
        self.codes = [m.start() for m in _CODES.finditer(text)]

    @cached_property
    def parts(self) -> list[tuple[str, int, int, bool]]:
        text, at, ends = self.text, 0, [len(self.text)]
        for m in _SENTENCE.finditer(text):
            ends += (m.start() + (text[m.start()] in "。！？"), m.end())
        ends = [*ends[1:], ends[0]]
        furnished, k, out = [*self.furnished, len(text)], 0, []
        for i in range(0, len(ends), 2):
            end = ends[i]
            if end > at:
                while furnished[k] < at:
                    k += 1
                out.append((text[at:end], at, end, furnished[k] < end))
            at = ends[i + 1] if i + 1 < len(ends) else end
        return out

    def holding(self, places: list[int]) -> list[int]:
        """The numbers of the parts that hold one of the places, in order; those between parts are of the part before."""
        begins = [a for _, a, _, _ in self.parts]
        return sorted({max(0, bisect_right(begins, p) - 1) for p in places}) if begins else []


def _filler(x: _Text) -> bool:
    ws = words_of(x.text)
    # the same word three times running, or the same two: then every sentence is looked at
    again = b"\1\1" in bytes(map(eq, ws, ws[1:])) or b"\1\1\1\1" in bytes(map(eq, ws, ws[2:]))
    if not ws or not again and not x.fills:
        return False
    for k in range(len(x.parts)) if again else x.holding(x.fills):
        part, _, _, furnished = x.parts[k]
        if any(_is_filler(y) for y in (_FURNITURE.sub("\n", part).split("\n") if furnished else (part,)) if y):
            return True
    return False


def _page(x: _Text) -> str | None:
    """'error' or 'scripts' if the text is such a page."""
    if not x.pages and not x.codes:
        return None
    parts = x.parts
    touched = x.holding(x.pages + x.codes)
    furniture, traces = False, 0

    def pieces(k: int) -> Iterator[tuple[str, int]]:
        """The sentences of a part without page furniture, with their words."""
        nonlocal furniture, traces
        part, _, _, furnished = parts[k]
        cut = [part]
        if furnished:
            ends = [0]
            for m in _FURNITURE.finditer(part):
                ends += m.span()
                if m["trace"]:
                    traces += 1
                else:
                    furniture = True
            cut = [part[i:j] for i, j in zip(ends[::2], [*ends[1::2], len(part)])]
        for y in cut:
            y = y.strip(_MARKS)
            if n := _n_words(y):
                yield y, n

    voice, content = 0, 0
    # few words of content beside the notices; the page's own voice may take several times their length
    few = lambda notices: content <= max(5, notices // 2) and voice <= 30 + 4 * notices

    def other(sentence: str, n: int) -> None:
        nonlocal voice, content
        if (_VOICE.search(sentence) or n <= 12 and _FAILED.search(sentence)) and not _narrated(sentence) and not _ABOUT.search(sentence):
            voice += n
        else:
            content += n

    most = sum(_n_words(parts[k][0]) for k in touched)  # words of what may be notices
    suspected = set(touched)
    for k in range(len(parts)):
        if k not in suspected:
            for y in pieces(k):
                other(*y)
            if not few(most):
                return None
    reason, weak, notices = None, 0, 0
    for k in touched:
        for y, n in pieces(k):
            if _WEAK.fullmatch(y) or _CODE_ALONE.fullmatch(y):
                weak += n
            elif kind := _notice(y, n):
                reason = reason or kind
                notices += n
            else:
                most -= n
                other(y, n)
                if not few(most):
                    return None
    if reason is None and (weak > 0) + min(traces, 2) + furniture + (voice > 0) >= 2 and (weak + traces or not content):
        reason = "error"  # no notice, but several things that stand beside one
    return reason if few(notices + weak) else None


def residue_of(text: str) -> str | None:
    """placeholder, filler, error, scripts, or None."""
    if _placeholder(text):
        return "placeholder"
    x = _Text(text)
    return "filler" if _filler(x) else _page(x)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, r) for i, t in enumerate(batch.column("text").to_pylist()) if (r := residue_of(t))]
        ids = batch.column("doc_id").take(pa.array([i for i, _ in found], pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array([r for _, r in found], pa.string())], names=["doc_id", "reason"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([not (t and residue_of(t)) for t in batch.column("text").to_pylist()], pa.bool_()))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, reason) of the documents to leave out."""
    return documents.filter("text <> ''").select(documents["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_reported, "doc_id long, reason string")


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that aren't reported, with all their columns: one pass, by row, whatever their ids."""
    return documents.mapInArrow(_kept, documents.schema)
