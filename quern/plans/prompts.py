"""Instructions for the model, in two languages; a run may give its own for each step."""

from __future__ import annotations

#: By language and step. The parts that follow an instruction (pages, topics, entities) are put there by the steps.
DEFAULTS = {
    "en": {
        "distill": 'Summarise every page below. Reply with JSON only: {"pages": [{"id": "p0", "title": "...", "summary": "two or three sentences", "keypoints": ["..."], "entities": [{"name": "...", "label": "Person, Organization, Location, Product or Topic", "props": {}}], "edges": [{"src": "entity", "rel": "RELATION_IN_CAPITALS", "dst": "entity"}]}]}. One object for each page, under the number of its mark. State only what the page says. Write in the page\'s language.',
        "assign": 'Sort the new documents into topics. Use a topic that is listed wherever one fits; otherwise make a new one that several documents could share. Reply with JSON only: {"assignments": [{"hash": "document", "slug": "topic"}], "new_clusters": [{"slug": "short-name", "name": "Name", "description": "one sentence", "members": ["document"]}]}. Every document belongs to one topic at least.',
        "article": "Write an article in Markdown about the topic from the excerpts below: what it is, then its facts under headings. Use nothing but the excerpts; where they contradict each other, say so. Begin with a metadata block between two lines of three dashes that holds the title.",
        "canonicalize": "Some entities of the list below may be the same thing under several names: spellings, short forms, translations. Reply with JSON only: an object whose field clusters is a list of objects with prefLabel (the best name), label, aliases (a list of the other names) and member_ids (a list of ids from the list). Leave out whatever is not certain.",
        "lint": "Read the beginnings of all articles below. Report in Markdown: articles about the same topic, contradictions, gaps, articles without sources. Name the articles concerned. Be brief.\n\n",
        "index": "Write the entry page of a knowledge base in Markdown from the list below: a few sentences on what it holds, then its articles under headings, each as a link [[name]] with a half sentence. Leave no article out.",
        "inventory": 'Find the topics of all pages below. Reply with JSON only: {"domain": "...", "main_topics": ["..."], "clusters": [{"slug": "short-name", "name": "Name", "description": "...", "files": ["path"]}]}.',
        "merge": "Unite the inventories below into one of the same form: equal topics become one cluster with the files of all. Reply with JSON only.",
        "suggestions": "From the index below, think of three or four questions that a reader could ask and that the articles answer. Reply with a JSON list of short strings only.",
        "route": "Which of the articles below help to answer the question? Reply with their names only, parted by commas, the best first, five at most; with none if there is none.",
    },
    "de": {
        "distill": 'Fasse jede Seite unten zusammen. Antworte nur mit JSON: {"pages": [{"id": "p0", "title": "...", "summary": "zwei bis drei Sätze", "keypoints": ["..."], "entities": [{"name": "...", "label": "Person, Organization, Location, Product oder Topic", "props": {}}], "edges": [{"src": "Entität", "rel": "BEZIEHUNG_IN_VERSALIEN", "dst": "Entität"}]}]}. Ein Objekt je Seite, unter der Nummer ihrer Marke. Nur was auf der Seite steht, in der Sprache der Seite.',
        "assign": 'Ordne die neuen Dokumente Themen zu. Nimm ein vorhandenes Thema, wo eines passt; sonst ein neues, unter das mehrere Dokumente fallen können. Antworte nur mit JSON: {"assignments": [{"hash": "Dokument", "slug": "thema"}], "new_clusters": [{"slug": "kurzname", "name": "Name", "description": "ein Satz", "members": ["Dokument"]}]}. Jedes Dokument gehört zu mindestens einem Thema.',
        "article": "Schreibe aus den Auszügen unten einen Artikel in Markdown über das Thema: was es ist, dann die Einzelheiten unter Überschriften. Verwende nur die Auszüge; wo sie einander widersprechen, sage es. Beginne mit einem Metadatenblock zwischen zwei Zeilen aus drei Strichen, der den Titel enthält.",
        "canonicalize": "Manche Entitäten der Liste unten sind womöglich dasselbe unter mehreren Namen: Schreibweisen, Kurzformen, Übersetzungen. Antworte nur mit JSON: ein Objekt, dessen Feld clusters eine Liste von Objekten ist mit prefLabel (dem besten Namen), label, aliases (einer Liste der übrigen Namen) und member_ids (einer Liste von Nummern aus der Liste). Lass weg, was nicht sicher ist.",
        "lint": "Lies die Anfänge aller Artikel unten. Berichte in Markdown: Artikel zum selben Thema, Widersprüche, Lücken, Artikel ohne Quellen. Nenne die betroffenen Artikel. Fasse dich kurz.\n\n",
        "index": "Schreibe aus der Liste unten die Einstiegsseite einer Wissensbasis in Markdown: wenige Sätze dazu, was sie enthält, dann ihre Artikel unter Überschriften, jeder als Verweis [[name]] mit einem halben Satz. Lass keinen Artikel aus.",
        "inventory": 'Finde die Themen aller Seiten unten. Antworte nur mit JSON: {"domain": "...", "main_topics": ["..."], "clusters": [{"slug": "kurzname", "name": "Name", "description": "...", "files": ["Pfad"]}]}.',
        "merge": "Vereinige die Inventare unten zu einem derselben Form: gleiche Themen werden ein Cluster mit den Dateien aller. Antworte nur mit JSON.",
        "suggestions": "Überlege zum Verzeichnis unten drei oder vier Fragen, die jemand stellen könnte und die die Artikel beantworten. Antworte nur mit einer JSON-Liste kurzer Zeichenketten.",
        "route": "Welche der Artikel unten helfen, die Frage zu beantworten? Antworte nur mit ihren Namen, durch Kommas getrennt, die besten zuerst, höchstens fünf; mit none, wenn es keinen gibt.",
    },
}


def prompts(language: str = "de", own: dict[str, str] | None = None) -> dict[str, str]:
    """The instructions of a language (German for one that has none), with a run's own in their place."""
    return DEFAULTS.get(language.lower().split("-")[0], DEFAULTS["de"]) | (own or {})
