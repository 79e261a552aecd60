"""Small lookup tables with a fixed size, each replaceable by the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Public suffixes of two labels. A host that ends in none of them has its last label as suffix, so
# suffixes of one label need no entry. A full list with wildcard and exception rules can be passed as a DataFrame.
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "nhs.uk", "org.uk", "plc.uk", "sch.uk",
    "com.ar", "com.au", "com.br", "com.cn", "com.co", "com.es", "com.hk", "com.mx", "com.my", "com.pe",
    "com.pl", "com.pt", "com.sg", "com.tr", "com.tw", "com.ua", "com.uy", "com.ve", "com.vn",
    "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.za",
    "edu.au", "gob.ar", "gob.es", "gob.mx", "gov.au", "gov.br", "gov.in", "net.au", "net.br",
    "nom.es", "or.jp", "or.kr", "org.ar", "org.au", "org.br", "org.es", "org.mx", "org.nz", "org.pl", "org.za",
)

# ISO 639, three-letter code (terminology) and two-letter code, and the bibliographic codes that differ.
ISO_639 = tuple(
    tuple(pair.split("-"))
    for pair in """
    aar-aa abk-ab afr-af aka-ak amh-am ara-ar arg-an asm-as ava-av ave-ae aym-ay aze-az bak-ba bam-bm bel-be ben-bn bis-bi bod-bo
    bos-bs bre-br bul-bg cat-ca ces-cs cha-ch che-ce chu-cu chv-cv cor-kw cos-co cre-cr cym-cy dan-da deu-de div-dv dzo-dz ell-el
    eng-en epo-eo est-et eus-eu ewe-ee fao-fo fas-fa fij-fj fin-fi fra-fr fry-fy ful-ff gla-gd gle-ga glg-gl glv-gv grn-gn guj-gu
    hat-ht hau-ha heb-he her-hz hin-hi hmo-ho hrv-hr hun-hu hye-hy ibo-ig ido-io iii-ii iku-iu ile-ie ina-ia ind-id ipk-ik isl-is
    ita-it jav-jv jpn-ja kal-kl kan-kn kas-ks kat-ka kau-kr kaz-kk khm-km kik-ki kin-rw kir-ky kom-kv kon-kg kor-ko kua-kj kur-ku
    lao-lo lat-la lav-lv lim-li lin-ln lit-lt ltz-lb lub-lu lug-lg mah-mh mal-ml mar-mr mkd-mk mlg-mg mlt-mt mon-mn mri-mi msa-ms
    mya-my nau-na nav-nv nbl-nr nde-nd ndo-ng nep-ne nld-nl nno-nn nob-nb nor-no nya-ny oci-oc oji-oj ori-or orm-om oss-os pan-pa
    pli-pi pol-pl por-pt pus-ps que-qu roh-rm ron-ro run-rn rus-ru sag-sg san-sa sin-si slk-sk slv-sl sme-se smo-sm sna-sn snd-sd
    som-so sot-st spa-es sqi-sq srd-sc srp-sr ssw-ss sun-su swa-sw swe-sv tah-ty tam-ta tat-tt tel-te tgk-tg tgl-tl tha-th tir-ti
    ton-to tsn-tn tso-ts tuk-tk tur-tr twi-tw uig-ug ukr-uk urd-ur uzb-uz ven-ve vie-vi vol-vo wln-wa wol-wo xho-xh yid-yi yor-yo
    zha-za zho-zh zul-zu
    alb-sq arm-hy baq-eu bur-my chi-zh cze-cs dut-nl fre-fr geo-ka ger-de gre-el ice-is mac-mk mao-mi may-ms per-fa rum-ro slo-sk
    tib-bo wel-cy
    """.split()
)


def iso_639(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ISO_639), "alpha3 string, alpha2 string")
