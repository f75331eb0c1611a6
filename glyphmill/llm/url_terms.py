"""The vocabulary of the URL filter, as a table: term, kind, weight, language and topic.

A strict term rejects alone: it names what is sold or done, and has hardly another sense. A soft one counts its weight, and 1 is needed: 0.75 where
the word belongs to the topic but has other senses, 0.5 where it goes with the topic and with much else, 0.25 for words that sell anything. So no soft term rejects
alone; a word of a topic and any word that sells do, as do two that go with topics, or four that sell. Weights are multiples of 1/8, so that sums are exact.
Words are written as they stand in addresses, without accents; digits and hyphens bound words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (language, topic, kind, weight, terms).
GROUPS = (
    ("en", "adult", "strict", 1.0, "porn porno pornos xxx adult escort escorts hentai camgirls camsex milf nsfw striptease bdsm fetish livesex"),
    ("de", "adult", "strict", 1.0, "erotik sexkontakte hobbyhuren pornofilme sexcam erotikfilme bordell"),
    ("fr", "adult", "strict", 1.0, "pornographie plancul escortes sexcams libertines camsexe"),
    ("es", "adult", "strict", 1.0, "pornografia putas escortes prostitutas sexoservicio webcamsexo"),
    ("en", "adult", "soft", 0.75, "sex nude nudes erotic naked hookup"),
    ("de", "adult", "soft", 0.75, "nackt erotisch seitensprung"),
    ("fr", "adult", "soft", 0.75, "nue sexe coquin erotique"),
    ("es", "adult", "soft", 0.75, "sexo desnuda desnudas eroticas"),
    ("en", "dating", "soft", 0.5, "dating singles flirt hot girls cams chat webcam"),
    ("de", "dating", "soft", 0.5, "partnersuche treffen kontakte"),
    ("fr", "dating", "soft", 0.5, "rencontre rencontres celibataires"),
    ("es", "dating", "soft", 0.5, "citas solteras solteros contactos"),
    ("en", "gambling", "strict", 1.0, "casino sportsbook betonline onlinecasino slotmachine"),
    ("de", "gambling", "strict", 1.0, "spielbank onlinecasinos spielautomaten sportwetten"),
    ("fr", "gambling", "strict", 1.0, "machinesasous parissportifs casinosenligne"),
    ("es", "gambling", "strict", 1.0, "tragaperras tragamonedas apuestasdeportivas"),
    ("en", "gambling", "soft", 0.75, "bets betting poker jackpot slots roulette blackjack baccarat gambling"),
    ("de", "gambling", "soft", 0.75, "wetten gluecksspiel wettbonus freispiele"),
    ("fr", "gambling", "soft", 0.75, "tierce mises loterie"),
    ("es", "gambling", "soft", 0.75, "apuestas ruleta loteria bingo"),
    ("en", "pharmacy", "strict", 1.0, "viagra cialis levitra tramadol xanax phentermine oxycontin sildenafil"),
    ("en", "pharmacy", "soft", 0.75, "pills pharmacy steroids weightloss diet"),
    ("de", "pharmacy", "soft", 0.75, "potenzmittel rezeptfrei abnehmen"),
    ("fr", "pharmacy", "soft", 0.75, "pilules maigrir sansordonnance"),
    ("es", "pharmacy", "soft", 0.75, "pastillas adelgazar sinreceta"),
    ("en", "loans", "soft", 0.75, "payday loans forex bitcoin crypto debt"),
    ("de", "loans", "soft", 0.75, "kredite sofortkredit schufafrei"),
    ("fr", "loans", "soft", 0.75, "prets rachatdecredit"),
    ("es", "loans", "soft", 0.75, "prestamos creditos"),
    ("en", "theft", "strict", 1.0, "warez torrents keygen keygens crackz malware phishing spam botnet serialz cardingforum"),
    ("en", "theft", "soft", 0.75, "crack cracked hack hacks torrent serials nulled leaked"),
    ("de", "theft", "soft", 0.75, "raubkopie geknackt"),
    ("fr", "theft", "soft", 0.75, "piratage telechargement"),
    ("es", "theft", "soft", 0.75, "pirateado descargas hackear"),
    ("en", "links", "soft", 0.5, "farm backlinks seo clicks traffic tracker popup adserver banner banners ads affiliate replica replicas"),
    ("en", "selling", "soft", 0.25, "free cheap win winner bonus deal deals discount offer offers best buy sale online promo coupon rich now fast easy top100"),
    ("de", "selling", "soft", 0.25, "gratis kostenlos guenstig billig gewinn gewinnen rabatt angebot angebote kaufen sofort"),
    ("fr", "selling", "soft", 0.25, "gratuit gratuits pascher gagner promo offre offres acheter soldes"),
    ("es", "selling", "soft", 0.25, "gratis barato baratos ganar oferta ofertas comprar descuento"),
)


def entries() -> list[tuple[str, str, float, str, str]]:
    """(term, kind, weight, language, topic); a term of several languages is there once for each."""
    return [(t, kind, weight, language, topic) for language, topic, kind, weight, terms in GROUPS for t in terms.split()]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(entries(), "term string, kind string, weight double, language string, topic string")
