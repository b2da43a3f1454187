"""Annotated sentences of our own, for the rules: they exercise each rule's positive, negative and scope cases.

A token is form/lemma/CLASS/label/head/features; head counts from 1 in its period, a root heads itself, `_` is a missing
value. Lines are periods; a document ends at an empty line.
"""

from __future__ import annotations

SENTENCES = """
Ela/ele/PRON/nsubj/3/_ não/não/ADV/advmod/3/_ quis/querer/VERB/ROOT/3/Tense=Past|VerbForm=Fin sair/sair/VERB/xcomp/3/VerbForm=Inf ././PUNCT/punct/3/_
Hoje/hoje/ADV/advmod/3/_ eu/eu/PRON/nsubj/3/_ posso/poder/VERB/ROOT/3/Mood=Ind|Tense=Pres|VerbForm=Fin dormir/dormir/VERB/xcomp/3/VerbForm=Inf cedo/cedo/ADV/advmod/4/_ ././PUNCT/punct/3/_
O/o/DET/det/2/_ amanhã/amanhã/NOUN/nsubj/3/_ assusta/assustar/VERB/ROOT/3/Tense=Pres|VerbForm=Fin ././PUNCT/punct/3/_

Não/não/ADV/advmod/3/_ só/só/ADV/advmod/3/_ cantou/cantar/VERB/ROOT/3/Tense=Past|VerbForm=Fin mas/mas/CCONJ/cc/6/_ também/também/ADV/advmod/6/_ dançou/dançar/VERB/conj/3/Tense=Past|VerbForm=Fin ././PUNCT/punct/3/_
Não/não/ADV/advmod/3/_ apenas/apenas/ADV/advmod/3/_ leu/ler/VERB/ROOT/3/Tense=Past|VerbForm=Fin ,/,/PUNCT/punct/6/_ mas/mas/CCONJ/cc/6/_ fugiu/fugir/VERB/conj/3/Tense=Past|VerbForm=Fin ././PUNCT/punct/3/_
Nunca/nunca/ADV/advmod/2/_ vi/ver/VERB/ROOT/2/Tense=Past|VerbForm=Fin nem/nem/CCONJ/cc/4/_ ouvi/ouvir/VERB/conj/2/Tense=Past|VerbForm=Fin nada/nada/PRON/obj/4/_ ././PUNCT/punct/2/_
Ninguém/ninguém/PRON/nsubj/3/_ nunca/nunca/ADV/advmod/3/_ disse/dizer/VERB/ROOT/3/Tense=Past|VerbForm=Fin não/não/ADV/advmod/3/_ ././PUNCT/punct/3/_

Ele/ele/PRON/nsubj/2/_ disse/dizer/VERB/ROOT/2/Tense=Past|VerbForm=Fin que/que/SCONJ/mark/6/_ eu/eu/PRON/nsubj/6/_ não/não/ADV/advmod/6/_ sabia/saber/VERB/ccomp/2/Tense=Imp|VerbForm=Fin nadar/nadar/VERB/xcomp/6/VerbForm=Inf ././PUNCT/punct/2/_
Sei/saber/VERB/ROOT/1/Tense=Pres|VerbForm=Fin que/que/SCONJ/mark/3/_ saiu/sair/VERB/ccomp/1/Tense=Past|VerbForm=Fin ././PUNCT/punct/1/_
Tenho/ter/VERB/ROOT/1/Tense=Pres|VerbForm=Fin de/de/ADP/mark/3/_ ir/ir/VERB/xcomp/1/VerbForm=Inf agora/agora/ADV/advmod/3/_ ././PUNCT/punct/1/_
Tenho/ter/VERB/ROOT/1/Tense=Pres|VerbForm=Fin um/um/DET/det/3/_ livro/livro/NOUN/obj/1/_ ././PUNCT/punct/1/_

A/o/DET/det/2/_ casa/casa/NOUN/nsubj/4/_ é/ser/AUX/cop/4/Tense=Pres|VerbForm=Fin grande/grande/ADJ/ROOT/4/_ ././PUNCT/punct/4/_
É/ser/AUX/cop/2/Tense=Pres|VerbForm=Fin necessário/necessário/ADJ/ROOT/2/_ esperar/esperar/VERB/csubj/2/VerbForm=Inf ././PUNCT/punct/2/_
As/o/DET/det/2/_ regras/regra/NOUN/nsubj/4/_ são/ser/AUX/cop/4/Tense=Pres|VerbForm=Fin obrigatórias/obrigatório/ADJ/ROOT/4/_ ././PUNCT/punct/4/_
Talvez/talvez/ADV/advmod/2/_ chova/chover/VERB/ROOT/2/Mood=Sub|VerbForm=Fin amanhã/amanhã/ADV/advmod/2/_ ././PUNCT/punct/2/_
Gente/gente/NOUN/ROOT/1/_ feliz/feliz/ADJ/amod/1/_ ././PUNCT/punct/1/_

Fiquei/ficar/VERB/ROOT/1/Tense=Past|VerbForm=Fin porque/porque/SCONJ/mark/3/_ chovia/chover/VERB/advcl/1/Tense=Imp|VerbForm=Fin ././PUNCT/punct/1/_
Se/se/SCONJ/mark/2/_ quiser/querer/VERB/advcl/4/Mood=Sub|VerbForm=Fin ,/,/PUNCT/punct/4/_ venha/vir/VERB/ROOT/4/Mood=Imp|VerbForm=Fin ././PUNCT/punct/4/_
Ele/ele/PRON/nsubj/3/_ se/se/PRON/expl/3/_ cortou/cortar/VERB/ROOT/3/Tense=Past|VerbForm=Fin ././PUNCT/punct/3/_
Quando/quando/ADV/advmod/2/_ cheguei/chegar/VERB/advcl/4/Tense=Past|VerbForm=Fin ,/,/PUNCT/punct/4/_ saíram/sair/VERB/ROOT/4/Tense=Past|VerbForm=Fin ././PUNCT/punct/4/_
Quero/querer/VERB/ROOT/1/Tense=Pres|VerbForm=Fin ir/ir/VERB/xcomp/1/VerbForm=Inf ,/,/PUNCT/punct/5/_ mas/mas/CCONJ/cc/5/_ temo/temer/VERB/conj/1/Tense=Pres|VerbForm=Fin ././PUNCT/punct/1/_
João/João/PROPN/ROOT/1/_ ,/,/PUNCT/punct/5/_ mas/mas/CCONJ/cc/5/_ não/não/ADV/advmod/5/_ Pedro/Pedro/PROPN/conj/1/_ ././PUNCT/punct/1/_

Caiu/cair/VERB/ROOT/1/Tense=Past|VerbForm=Fin ;/;/PUNCT/punct/5/_ por/por/ADP/case/4/_ isso/isso/PRON/obl/5/_ chorou/chorar/VERB/conj/1/Tense=Past|VerbForm=Fin ././PUNCT/punct/1/_
Lutei/lutar/VERB/ROOT/1/Tense=Past|VerbForm=Fin por/por/ADP/case/3/_ isso/isso/PRON/obl/1/_ ././PUNCT/punct/1/_
Ela/ele/PRON/nsubj/2/_ gritou/gritar/VERB/ROOT/2/Tense=Past|VerbForm=Fin :/:/PUNCT/punct/6/_ “/“/PUNCT/punct/6/_ Não/não/ADV/advmod/6/_ vou/ir/VERB/parataxis/2/Tense=Pres|VerbForm=Fin ”/”/PUNCT/punct/6/_ ././PUNCT/punct/2/_
A/o/DET/det/2/_ palavra/palavra/NOUN/nsubj/6/_ "/"/PUNCT/punct/4/_ não/não/NOUN/appos/2/_ "/"/PUNCT/punct/4/_ dói/doer/VERB/ROOT/6/Tense=Pres|VerbForm=Fin ././PUNCT/punct/6/_
Escreveu/escrever/VERB/ROOT/1/Tense=Past|VerbForm=Fin «/«/PUNCT/punct/3/_ nunca/nunca/ADV/advmod/4/_ volto/voltar/VERB/parataxis/1/Tense=Pres|VerbForm=Fin ././PUNCT/punct/1/_

Devo/dever/AUX/aux/2/Tense=Pres|VerbForm=Fin estudar/estudar/VERB/ROOT/2/VerbForm=Inf mais/mais/ADV/advmod/2/_ ././PUNCT/punct/2/_
Consegui/conseguir/VERB/ROOT/1/Tense=Past|VerbForm=Fin abrir/abrir/VERB/xcomp/1/VerbForm=Inf a/o/DET/det/4/_ porta/porta/NOUN/obj/2/_ ././PUNCT/punct/1/_
Não/não/ADV/advmod/2/_ duvido/duvidar/VERB/ROOT/2/Tense=Pres|VerbForm=Fin que/que/SCONJ/mark/4/_ venha/vir/VERB/ccomp/2/Mood=Sub|VerbForm=Fin ././PUNCT/punct/2/_
Algo/algo/_/nsubj/2/_ precisa/precisar/VERB/ROOT/2/Tense=Pres|VerbForm=Fin mudar/mudar/VERB/xcomp/2/VerbForm=Inf ././PUNCT/punct/2/_
Não/não/INTJ/ROOT/1/_ ././PUNCT/punct/1/_

Não/não/ADV/advmod/3/_ só/só/ADV/advmod/3/_ escreveu/escrever/VERB/ROOT/3/Tense=Past|VerbForm=Fin mas/mas/CCONJ/cc/6/_ também/também/ADV/advmod/6/_ leu/ler/VERB/conj/3/Tense=Past|VerbForm=Fin
Não/não/ADV/advmod/2/_ posso/poder/VERB/ROOT/2/Mood=Ind|VerbForm=Fin sair/sair/VERB/xcomp/2/VerbForm=Inf ././PUNCT/punct/2/_
Quero/querer/VERB/ROOT/1/Tense=Pres|VerbForm=Fin não/não/ADV/advmod/3/_ ir/ir/VERB/xcomp/1/VerbForm=Inf ././PUNCT/punct/1/_
Deve/dever/VERB/ROOT/1/Tense=Pres|VerbForm=Fin chover/chover/VERB/xcomp/1/VerbForm=Inf hoje/hoje/ADV/advmod/2/_ ././PUNCT/punct/1/_
Pode/poder/VERB/ROOT/1/Tense=Pres|VerbForm=Fin ././PUNCT/punct/1/_
Eu/eu/PRON/nsubj/5/_ não/não/ADV/advmod/5/_ sou/ser/AUX/cop/5/Tense=Pres|VerbForm=Fin bem/bem/ADV/advmod/5/_ capaz/capaz/ADJ/ROOT/5/_ de/de/ADP/mark/8/_ nunca/nunca/ADV/advmod/8/_ mentir/mentir/VERB/xcomp/5/VerbForm=Inf ././PUNCT/punct/5/_

Eles/ele/PRON/nsubj/4/_ não/não/ADV/advmod/4/_ só/só/ADV/advmod/4/_ cantam/cantar/VERB/ROOT/4/Tense=Pres|VerbForm=Fin mas/mas/CCONJ/cc/7/_ também/também/ADV/advmod/7/_ dançam/dançar/VERB/conj/4/Tense=Pres|VerbForm=Fin
Não/não/_/advmod/2/_ saiu/sair/VERB/ROOT/2/Tense=Past|VerbForm=Fin ././PUNCT/punct/2/_
Foi/ir/VERB/ROOT/1/_ embora/embora/ADV/advmod/1/_ ././PUNCT/punct/1/_
Fez/_/VERB/ROOT/1/Tense=Past|VerbForm=Fin tudo/tudo/PRON/obj/1/_ ././PUNCT/punct/1/_
São/ser/AUX/cop/2/Tense=Pres|VerbForm=Fin obrigatórias/_/ADJ/ROOT/2/_ ././PUNCT/punct/2/_
Sabe/saber/VERB/ROOT/1/Tense=Pres|VerbForm=Fin nadar/nadar/VERB/xcomp/1/_ ././PUNCT/punct/1/_

Nunca/nunca/ADV/advmod/3/_ não/não/ADV/advmod/3/_ respondi/responder/VERB/ROOT/3/Tense=Past|VerbForm=Fin ././PUNCT/punct/3/_
Nem/nem/CCONJ/cc/3/_ nunca/nunca/ADV/advmod/3/_ dormiu/dormir/VERB/ROOT/3/Tense=Past|VerbForm=Fin ././PUNCT/punct/3/_
Não/não/ADV/advmod/2/_ comeu/comer/VERB/ROOT/2/Tense=Past|VerbForm=Fin nem/nem/CCONJ/cc/4/_ bebeu/beber/VERB/conj/2/Tense=Past|VerbForm=Fin ././PUNCT/punct/2/_
Viu/ver/VERB/ROOT/1/Tense=Past|VerbForm=Fin nem/nem/CCONJ/cc/3/_ casas/casa/NOUN/obj/1/_ ././PUNCT/punct/1/_

Choveu/chover/VERB/ROOT/1/Tense=Past|VerbForm=Fin ,/,/PUNCT/punct/5/_ por/por/ADP/case/4/_ isso/isso/PRON/obl/5/_ ficou/ficar/VERB/conj/1/Tense=Past|VerbForm=Fin ././PUNCT/punct/1/_
Por/por/ADP/case/2/_ isso/isso/PRON/obl/3/_ partiu/partir/VERB/ROOT/3/Tense=Past|VerbForm=Fin ././PUNCT/punct/3/_
Por/por/ADP/case/2/_ isso/isso/_/obl/3/_ veio/vir/VERB/ROOT/3/Tense=Past|VerbForm=Fin ././PUNCT/punct/3/_
Disse/dizer/VERB/ROOT/1/Tense=Past|VerbForm=Fin que/que/SCONJ/mark/3/_ ficou/ficar/VERB/ccomp/1/Tense=Past|VerbForm=Fin porque/porque/SCONJ/mark/5/_ chovia/chover/VERB/advcl/3/Tense=Imp|VerbForm=Fin ././PUNCT/punct/1/_
Contou/contar/VERB/ROOT/1/Tense=Past|VerbForm=Fin porque/porque/SCONJ/mark/3/_ fugiu/fugir/VERB/ccomp/1/Tense=Past|VerbForm=Fin ././PUNCT/punct/1/_

Ele/ele/PRON/nsubj/2/_ gritou/gritar/VERB/ROOT/2/Tense=Past|VerbForm=Fin “/“/PUNCT/punct/6/_ «/«/PUNCT/punct/6/_ nunca/nunca/ADV/advmod/6/_ volto/voltar/VERB/parataxis/2/Tense=Pres|VerbForm=Fin »/»/PUNCT/punct/6/_ ”/”/PUNCT/punct/6/_
Mas/mas/_/cc/2/_ saiu/sair/VERB/ROOT/2/Tense=Past|VerbForm=Fin ././PUNCT/punct/2/_
Quando/quando/_/advmod/2/_ chegou/chegar/VERB/advcl/4/Tense=Past|VerbForm=Fin ,/,/PUNCT/punct/4/_ saiu/sair/VERB/ROOT/4/Tense=Past|VerbForm=Fin ././PUNCT/punct/4/_
"""

COLUMNS = "doc_id long, period int, ord int, token string, lemma string, pos string, dep string, head int, feats string"


def rows() -> list[tuple]:
    out, doc, period, ord_ = [], 0, 0, 0
    for line in SENTENCES.strip("\n").split("\n"):
        if not line:
            doc, period, ord_ = doc + 1, 0, 0
            continue
        words = line.split(" ")
        for w in words:
            form, lemma, pos, dep, head, feats = w.split("/") if not w.startswith("/") else [w[0], *w[2:].split("/")]
            out.append((doc, period, len([r for r in out if r[0] == doc]), form, None if lemma == "_" else lemma, None if pos == "_" else pos, dep, ord_ + int(head) - 1, None if feats == "_" else feats))
        ord_ += len(words)
        period += 1
    return out


def annotated(spark):
    """The sentences as a table: doc_id, period, ord, token, lemma, pos, dep, head (ord of the head), feats."""
    return spark.createDataFrame(rows(), COLUMNS)


def as_sql() -> str:
    """The same rows as a VALUES list."""
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    values = ",\n".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows())
    return f"SELECT * REPLACE (CAST(doc_id AS BIGINT) AS doc_id) FROM (VALUES {values}) AS v(doc_id, period, ord, token, lemma, pos, dep, head, feats)"
