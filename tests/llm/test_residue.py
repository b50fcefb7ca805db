"""P8: residue that must be reported, and text that only looks like it."""

import pytest

from lectern.llm import residue

CONTENT = "The harbour and the gentle bucket over Sunville returned the ladder before noon."
RESIDUE = [
    ("placeholder", f"{CONTENT}\nDear {x}, thank you for reading.")
    for x in ("{{name}}", "{{ clip.title }}", "${room}", "#{room}", "%(room)s", "%ROOM_NAME%", "$ROOM$", "<%= room %>", "{% block room %}{% endblock %}", "<insert room>", "<SPEAKER_NAME>", "&lt;utt_count&gt;", "[[room]]", "[[first name]]", "[INSERT ROOM HERE]", "[Your room]", "[room to be filled in]", "{first_name}", "{3}", "@@room@@", "__ROOM_NAME__")
] + [
    ("filler", "Lorem ipsum dolor sit amet, consectetur adipiscing elit."), ("filler", f"{CONTENT}\n\nSample text goes here.\n\n{CONTENT}"), ("filler", "asdf asdf qwer zxcv"), ("filler", "Text text text."), ("filler", "test test test 123"),
    ("filler", "Hier steht später der Text."), ("filler", "Texto de relleno para la maqueta."), ("filler", "Texte de remplissage à modifier."), ("filler", "Chapter 3 Nulla ipsum iniquor ellus partem lorem eratum dolor."),
    ("error", "404 Not Found"), ("error", "Skip to main content - HTTP 503 (Service Unavailable) - The backend timed out. - Request id 7f3a"), ("error", "PAGE NOT FOUND\nTRY AGAIN LATER."), ("error", "Seite nicht gefunden"), ("error", "Página no encontrada"),
    ("error", "Erreur interne du serveur"), ("error", "Traceback (most recent call last): KeyError: 'x'"), ("error", "Oops! Something went wrong"), ("error", "You do not have permission to view this recording."),
    ("scripts", "Please enable JavaScript to view this page."), ("scripts", "Bitte aktivieren Sie JavaScript, um die Aufnahme anzuhören."), ("scripts", "Home | Help\nYour browser has scripts disabled."), ("scripts", "Cette page ne fonctionne pas sans scripts."),
]
KEPT = [
    "", " ", CONTENT, "[00:06] ABCDE: the ladder fell {breath} and [noise] then <unk> stopped", "The template has [brackets] around optional words, and readers skipped them.",
    f"{CONTENT} In the sheet header the mark `{{{{speaker}}}}` stands for the code, and the exporter had filled it in.", "Write '[INSERT ROOM HERE]' in the draft if the room is unknown, and never leave it in a release.",
    "Older exports wrote “%ROOM%” where the room belonged; we repaired the rows by hand.", "The parser reads <ACCENT> as the accent and drops nothing, as 47 checks showed.", 'Row 3 looks like {"op": "delete", "ref_word": "the"} and needs no further check.',
    f"Use this in your page:\n```\nHello {{{{name}}}}\n```\n{CONTENT}", "A vendor sample was full of lorem ipsum and we threw all 3 lines of it away.", "The speakers said that test test test feels odd as a sound check.", "For 13 clips the mirror answered HTTP 500, so we used the backup copy.",
    "In batch 58 the log shows 404 Not Found for the first hour only.", "Clip 5 came back with error 403 twice before the download worked.", "The old player asked people to enable JavaScript, and 12 of them wrote to us.", "When Leven switched scripts off, the clip list still opened.",
    f"404 Not Found\n{CONTENT}", "Set the path to $HOME/data and the rate to 5, then 9 clips fit in memory.",
]


@pytest.mark.parametrize("reason,text", RESIDUE)
def test_reported(reason, text):
    assert residue.residue_of(text) == reason


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert residue.residue_of(text) is None


def test_table(spark):
    schema = "doc_id long, text string, reason string"
    rows = [(1, "404 Not Found", "clash"), (2, CONTENT, "clash"), (3, None, None), (4, "", ""), (None, "Text text text.", ""), (None, CONTENT, ""), (5, CONTENT * 3000 + "\nDear {{name}}, hello.", ""), (5, CONTENT, "")]
    df = spark.createDataFrame(rows, schema)
    assert {(r.doc_id, r.reason) for r in residue.residue(df).collect()} == {(1, "error"), (None, "filler"), (5, "placeholder")}
    kept = residue.without_residue(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text, r.reason) for r in kept.collect() if r.text) == sorted([("2", CONTENT, "clash"), ("None", CONTENT, ""), ("5", CONTENT, "")])
    assert sorted(r.doc_id for r in kept.collect() if not r.text) == [3, 4]
    assert residue.residue(spark.createDataFrame([], schema)).collect() == [] == residue.without_residue(spark.createDataFrame([], schema)).collect()


# Written apart from the rules: pages and texts of other makers and languages.
OTHER_RESIDUE = [
    ("error", "Errore 404: pagina non trovata"), ("error", "Página não encontrada"), ("error", "404 Pagina niet gevonden"), ("error", "Ошибка 404. Страница не найдена"), ("error", "找不到页面"), ("error", "404 ページが見つかりません"),
    ("error", "Błąd 404 - strona nie została znaleziona"), ("error", "Fel 404: Sidan kunde inte hittas"), ("error", "La pagina richiesta non esiste più. Torna alla home page."), ("error", "Der Dienst ist zurzeit nicht erreichbar. Bitte versuchen Sie es später erneut."),
    ("error", "404 Not Found. The page you requested could not be found on this server. It may have been moved, renamed or deleted, or the link may be out of date. Please check the address for typing errors, go back to the previous page, or use the search box at the top of this page. If you think this is a mistake, contact the webmaster and tell us how you came here."),
    ("error", "© SOME PORTAL 429 TOO MANY REQUESTS TRACEBACK (MOST RECENT CALL LAST): KEYERROR: 'WORDS' GO BACK TO THE START PAGE."),
    ("scripts", "Per vedere questa pagina attiva JavaScript"), ("scripts", "Включите JavaScript, чтобы продолжить"), ("scripts", "请启用JavaScript"), ("scripts", "JavaScriptを有効にしてください"), ("scripts", "Ative o JavaScript para continuar"), ("scripts", "Zet JavaScript aan; zonder JavaScript werkt deze pagina niet."),
    ("placeholder", "Dear <name>, welcome."), ("placeholder", "Dear [Name], your order [Order Number] is on its way."), ("placeholder", "Hello [first_name], welcome."), ("placeholder", "We wrote to ##name## about it."), ("placeholder", "Dear *|FNAME|*, hello."), ("placeholder", "Title: TBD"), ("placeholder", "Report\nDate: ____\nRoom: 4"),
    ("filler", "Testo segnaposto per la pagina"), ("filler", "Overview Placeholder text goes in this box."),
]
OTHER_KEPT = [
    "Use {{name}} in your template to insert the name, and {{date}} for the date.", "In Jinja, a loop is written {% for x in items %} and ends with {% endfor %}. Variables use {{ x }}.\nFilters change a variable: {{ x|upper }}.",
    "echo ${HOME}", "class A:\n    def __init__(self): pass", "The __init__ method runs first.", "Set %APPDATA% first.", "<HTML> is the root of the page.", "See [[Harbour]] for more.", "Let {x} be a set.", "[laughter] Then [noise] and [unk] came.",
    "404\n页面上的内容很长，这里有许多关于港口和梯子的文字，大家都很喜欢阅读这些文字。", "Sorry, I missed you. Call me.", "Gone with the wind.", "Forbidden fruit tastes best.", "The road was blocked.", "Santa does not exist.", "The actor had no script.",
    "The actors had no scripts.", "Glass falls.", "Shall Dad ask?", f"The page was torn. {CONTENT} {CONTENT}", "The sparrow didn't load the saddle because Koro didn't answer.", "404 speakers took part in the survey this year.",
]


@pytest.mark.parametrize("reason,text", OTHER_RESIDUE)
def test_other_residue(reason, text):
    assert residue.residue_of(text) == reason


@pytest.mark.parametrize("text", OTHER_KEPT)
def test_other_texts_are_kept(text):
    assert residue.residue_of(text) is None


def test_length_changes_nothing():
    """A notice, a content sentence and filler of any length are judged alike."""
    long = "The page that you asked for could not be found on this server because of a problem with " + " and ".join(["the database of the corpus"] * 40)
    assert residue.residue_of(long) == "error"
    assert residue.residue_of("404 Not Found\n" + " ".join([CONTENT] * 500)) is None
    assert residue.residue_of(" ".join([CONTENT] * 500) + "\n" + "foo bar " * 5000) == "filler"


@pytest.mark.parametrize("text", ["Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.", "jkl jkl", "dfgh dfgh", "Insert your name here", "Add a sentence", "Contenido provisional", "foo foo foo", "blah " * 20])
def test_every_accepted_form_is_reported(text):
    assert residue._is_filler(text) and residue.residue_of(f"{CONTENT}\n{text}\n{CONTENT}") == "filler"
