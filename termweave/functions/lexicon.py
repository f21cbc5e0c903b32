"""Word lists, unit tables and names whose content results depend on."""

from __future__ import annotations

#: Fixed values. International or British drug names and the names used in the United States.
USAN_OF_INN = {
    "paracetamol": "acetaminophen",
    "salbutamol": "albuterol",
    "salbutamol sulfate": "albuterol sulfate",
    "adrenaline": "epinephrine",
    "noradrenaline": "norepinephrine",
    "aciclovir": "acyclovir",
    "cefalexin": "cephalexin",
    "cefradine": "cephradine",
    "ciclosporin": "cyclosporine",
    "glyceryl trinitrate": "nitroglycerin",
    "lignocaine": "lidocaine",
    "lignocaine hydrochloride": "lidocaine hydrochloride",
    "rifampicin": "rifampin",
    "glibenclamide": "glyburide",
    "isoprenaline": "isoproterenol",
    "isoprenaline hydrochloride": "isoproterenol hydrochloride",
    "orciprenaline": "metaproterenol",
    "orciprenaline sulfate": "metaproterenol sulfate",
    "pethidine": "meperidine",
    "pethidine hydrochloride": "meperidine hydrochloride",
    "thiamazole": "methimazole",
    "hydroxycarbamide": "hydroxyurea",
    "chlortalidone": "chlorthalidone",
    "colestyramine": "cholestyramine",
    "chlorphenamine": "chlorpheniramine",
    "ethinylestradiol": "ethinyl estradiol",
    "metamizole": "dipyrone",
    "amfetamine": "amphetamine",
    "glycopyrronium": "glycopyrrolate",
    "clomifene": "clomiphene",
    "frusemide": "furosemide",
    "thiopentone": "thiopental",
    "oestradiol": "estradiol",
    "oestrone": "estrone",
    "oestriol": "estriol",
    "suxamethonium": "succinylcholine",
    "suxamethonium chloride": "succinylcholine chloride",
    "phenobarbitone": "phenobarbital",
    "phenobarbitone sodium": "phenobarbital sodium",
    "meclozine": "meclizine",
    "dicycloverine": "dicyclomine",
    "thiomersal": "thimerosal",
    "sodium cromoglicate": "cromolyn sodium",
    "aluminium": "aluminum",
    "sulphate": "sulfate",
    "guaiphenesin": "guaifenesin",
    "amoxycillin": "amoxicillin",
    "mesalazine": "mesalamine",
    "phytomenadione": "phytonadione",
    "benzylpenicillin": "penicillin G",
    "dimeticone": "dimethicone",
    "oxetacaine": "oxethazaine",
    "mepyramine": "pyrilamine",
    "methylthioninium chloride": "methylene blue",
    "clopidogrel bisulphate": "clopidogrel bisulfate",
    "imatinib mesilate": "imatinib mesylate",
    "ketorolac trometamol": "ketorolac tromethamine",
    "sodium picosulphate": "sodium picosulfate",
    "beclometasone": "beclomethasone",
    "beclometasone dipropionate": "beclomethasone dipropionate",
}

#: Fixed values. As above, applied only when asked for.
USAN_OF_INN_OPTIONAL = {
    "glucose": "dextrose",
}

#: Fixed values. Units of an amount, as patterns, in the order in which they are tried.
NUMERATOR_UNITS = (
    r"anti[-\s]?xa\s+unit(?:s)?",
    r"d\s*antigen(?:\s+unit)?(?:s)?",
    r"elisa\s*u",
    r"vaccinating\s+dose(?:s)?",
    r"billion\s+organism(?:s)?",
    r"billion\s+spore(?:s)?",
    r"sq[-\s]?hdm",
    "log10ccid50",
    "lgccid50",
    "ccid50",
    "tcid50",
    "ld50",
    "pfu",
    "cfu",
    "mbq",
    "lsu",
    "lf",
    "au",
    "bau",
    "kiu",
    "mu",
    "iu",
    "meq",
    "mmol",
    "microgram(?:s)?",
    "ug",
    "milligram(?:s)?",
    "gram(?:s)?",
    "mcg",
    "mg",
    "g",
    "mcl",
    "mls?",
    "l",
    "w",
    "unit(?:s)?",
    "unt",
)

#: Fixed values. Units that an amount is given per, as patterns, in the order in which they are tried.
DENOMINATOR_UNITS = (
    r"unit\s+dose(?:s)?",
    r"dropper\s+bottle(?:s)?",
    r"prefilled\s+pen(?:s)?",
    r"prefilled\s+syr(?:inge)?(?:s)?",
    r"sq\.?\s*cm\.?",
    r"d\s*antigen(?:\s+unit)?(?:s)?",
    "actuation(?:s)?",
    "actuat",
    "puff(?:s)?",
    "spray(?:s)?",
    "drop(?:s)?",
    "dose(?:s)?",
    "tablet(?:s)?",
    "capsule(?:s)?",
    "lozenge(?:s)?",
    "patch(?:es)?",
    "implant(?:s)?",
    "bead(?:s)?",
    "wafer(?:s)?",
    "suppositor(?:y|ies)",
    "ampoule(?:s)?",
    "applicator(?:s)?",
    "bag(?:s)?",
    "bar(?:s)?",
    "bottle(?:s)?",
    "box(?:es)?",
    "bucket(?:s)?",
    "can(?:s)?",
    "canister(?:s)?",
    "cartridge(?:s)?",
    "gallon(?:s)?",
    "gum",
    "inhalation(?:s)?",
    "inhaler(?:s)?",
    "jar(?:s)?",
    "measure(?:s)?",
    "pack(?:s)?",
    "pen(?:s)?",
    "piece(?:s)?",
    "sachet(?:s)?",
    "set(?:s)?",
    "sheet(?:s)?",
    "syringe(?:s)?",
    "tube(?:s)?",
    "vial(?:s)?",
    "gallon(?:s)?",
    "kg",
    "g",
    "gram(?:s)?",
    "mg",
    "mcg",
    "mls?",
    "mcl",
    "l",
    "iu",
    "meq",
    "mmol",
    "mu",
    "au",
    "bau",
    "unit(?:s)?",
    "unt",
    "hr|hour|hours|h|day|days",
)

#: Fixed values. Unit, factor, canonical unit: mass.
MASS_UNITS = {
    "mg": (1.0, "mg"),
    "milligram": (1.0, "mg"),
    "g": (1000.0, "mg"),
    "gram": (1000.0, "mg"),
    "kg": (1000000.0, "mg"),
    "mcg": (0.001, "mg"),
    "ug": (0.001, "mg"),
    "microgram": (0.001, "mg"),
}

#: Fixed values. Volume.
VOLUME_UNITS = {
    "ml": (1.0, "ml"),
    "mcl": (0.001, "ml"),
    "l": (1000.0, "ml"),
    "liter": (1000.0, "ml"),
    "litre": (1000.0, "ml"),
    "gallon": (3785.411784, "ml"),
}

#: Fixed values. International units.
INTERNATIONAL_UNITS = {
    "iu": (1.0, "iu"),
    "kiu": (1000.0, "iu"),
    "mu": (1000000.0, "iu"),
}

#: Fixed values. Other units of activity.
OTHER_UNITS = {
    "meq": (1.0, "meq"),
    "mmol": (1.0, "mmol"),
    "au": (1.0, "au"),
    "bau": (1.0, "bau"),
    "pfu": (1.0, "pfu"),
    "cfu": (1.0, "cfu"),
    "mbq": (1.0, "mbq"),
    "lsu": (1.0, "lsu"),
    "lf": (1.0, "lf"),
    "ld50": (1.0, "ld50"),
    "ccid50": (1.0, "ccid50"),
    "tcid50": (1.0, "tcid50"),
    "lgccid50": (1.0, "lgccid50"),
    "log10ccid50": (1.0, "log10ccid50"),
    "sq hdm": (1.0, "sq-hdm"),
    "w": (1.0, "w"),
    "anti xa unit": (1.0, "anti-xa unit"),
    "d antigen": (1.0, "d antigen"),
    "d antigen unit": (1.0, "d antigen"),
    "elisa u": (1.0, "elisa u"),
    "vaccinating dose": (1.0, "vaccinating dose"),
    "billion organism": (1.0, "billion organism"),
    "billion spore": (1.0, "billion spore"),
    "unit": (1.0, "unit"),
    "unt": (1.0, "unit"),
}

#: Fixed values. Things that are counted.
COUNTED_UNITS = {
    "actuation": (1.0, "actuation"),
    "actuat": (1.0, "actuation"),
    "puff": (1.0, "actuation"),
    "spray": (1.0, "actuation"),
    "drop": (1.0, "drop"),
    "dose": (1.0, "dose"),
    "tablet": (1.0, "tablet"),
    "capsule": (1.0, "capsule"),
    "lozenge": (1.0, "lozenge"),
    "patch": (1.0, "patch"),
    "implant": (1.0, "implant"),
    "bead": (1.0, "bead"),
    "wafer": (1.0, "wafer"),
    "suppository": (1.0, "suppository"),
    "ampoule": (1.0, "ampoule"),
    "applicator": (1.0, "applicator"),
    "bag": (1.0, "bag"),
    "bar": (1.0, "bar"),
    "bottle": (1.0, "bottle"),
    "box": (1.0, "box"),
    "bucket": (1.0, "bucket"),
    "can": (1.0, "can"),
    "canister": (1.0, "canister"),
    "cartridge": (1.0, "cartridge"),
    "dropper bottle": (1.0, "dropper bottle"),
    "gum": (1.0, "gum"),
    "inhalation": (1.0, "inhalation"),
    "inhaler": (1.0, "inhaler"),
    "jar": (1.0, "jar"),
    "measure": (1.0, "measure"),
    "pack": (1.0, "pack"),
    "pen": (1.0, "pen"),
    "piece": (1.0, "piece"),
    "prefilled pen": (1.0, "prefilled pen"),
    "prefilled syr": (1.0, "prefilled syringe"),
    "prefilled syringe": (1.0, "prefilled syringe"),
    "sachet": (1.0, "sachet"),
    "set": (1.0, "set"),
    "sheet": (1.0, "sheet"),
    "syringe": (1.0, "syringe"),
    "tube": (1.0, "tube"),
    "unit dose": (1.0, "unit dose"),
    "vial": (1.0, "vial"),
    "sqcm": (1.0, "sq.cm"),
    "hr": (1.0, "hr"),
    "hour": (1.0, "hr"),
    "day": (1.0, "day"),
}

#: Fixed values. Words and abbreviations of dosage forms in several languages, and the word that stands for them.
FORM_WORDS = {
    "aerosol": "spray",
    "aerosols": "spray",
    "cap": "capsule",
    "caps": "capsule",
    "capsula": "capsule",
    "capsulas": "capsule",
    "capsule": "capsule",
    "capsules": "capsule",
    "comprime": "tablet",
    "comprimido": "tablet",
    "comprimidos": "tablet",
    "compressa": "tablet",
    "compresse": "tablet",
    "crema": "cream",
    "creme": "cream",
    "cream": "cream",
    "drop": "solution",
    "drops": "solution",
    "gel": "gel",
    "gota": "solution",
    "gotas": "solution",
    "goutte": "solution",
    "gouttes": "solution",
    "implante": "implant",
    "implantes": "implant",
    "implant": "implant",
    "implants": "implant",
    "inalacao": "inhalation",
    "inhalacao": "inhalation",
    "inhalacion": "inhalation",
    "inhalation": "inhalation",
    "inhaler": "inhalation",
    "inhal": "inhalation",
    "inj": "inject",
    "injeccion": "inject",
    "injecao": "inject",
    "injetavel": "inject",
    "inject": "inject",
    "injection": "inject",
    "injectable": "inject",
    "injectables": "inject",
    "injt": "inject",
    "inyeccion": "inject",
    "inyectable": "inject",
    "loz": "lozenge",
    "lozenge": "lozenge",
    "oral": "oral",
    "orale": "oral",
    "orales": "oral",
    "patch": "patch",
    "patches": "patch",
    "pastilla": "lozenge",
    "pastillas": "lozenge",
    "pastille": "lozenge",
    "plaster": "patch",
    "plasters": "patch",
    "pomada": "ointment",
    "pomata": "ointment",
    "pommade": "ointment",
    "powder": "powder",
    "poudre": "powder",
    "pwdr": "powder",
    "sirup": "syrup",
    "sirop": "syrup",
    "soln": "solution",
    "oph": "ophthalmic",
    "solucion": "solution",
    "solucao": "solution",
    "solution": "solution",
    "soluzione": "solution",
    "spray": "spray",
    "sprays": "spray",
    "nasal": "nasal",
    "susp": "suspension",
    "suspension": "suspension",
    "suspensao": "suspension",
    "syrup": "syrup",
    "tableta": "tablet",
    "tabletas": "tablet",
    "tablet": "tablet",
    "tablets": "tablet",
    "tablette": "tablet",
    "tabletten": "tablet",
    "tab": "tablet",
    "tabs": "tablet",
    "topical": "topical",
    "topico": "topical",
    "transdermal": "patch",
    "troche": "lozenge",
    "unguento": "ointment",
    "unguent": "ointment",
    "ointment": "ointment",
    "jarabe": "syrup",
    "xarope": "syrup",
    "polvo": "powder",
    "pulver": "powder",
    "granule": "granule",
    "granules": "granule",
    "granulo": "granule",
    "granulos": "granule",
    "supp": "suppository",
    "suppositories": "suppository",
    "suppository": "suppository",
    "suppositoire": "suppository",
    "supositorio": "suppository",
    "supositorios": "suppository",
    "infusion": "infusion",
    "infusao": "infusion",
    "irrigation": "irrigation",
}

#: Fixed values. Release: abbreviations, names, abbreviation and label used in the United States.
RELEASES = {
    "immediate_release": (("IR",), ("immediate release", "immediate-release", "conventional release"), "IR", "immediate-release"),
    "delayed_release": (("DR",), ("delayed release", "delayed-release"), "DR", "delayed-release"),
    "gastro_resistant": (("GR", "EC"), ("gastro-resistant", "gastro resistant", "enteric-coated", "enteric coated", "acid-resistant", "acid resistant"), "DR", "delayed-release (enteric-coated)"),
    "extended_release": (("ER", "XR", "XL", "SR", "CR", "PR", "LA", "MR"), ("extended release", "extended-release", "sustained release", "sustained-release", "controlled release", "controlled-release", "long acting", "long-acting", "prolonged release", "prolonged-release", "modified release", "modified-release"), "ER", "extended-release"),
}

#: Fixed values. Dosage form: route, form, names, label used in the United States.
DOSAGE_FORMS = {
    "oral_tablet": ("oral", "tablet", ("tablet", "tab", "oral tablet"), "tablet"),
    "oral_tablet_film_coated": ("oral", "tablet", ("film-coated tablet", "film coated tablet", "fct"), "film-coated tablet"),
    "oral_tablet_orodispersible": ("oral", "tablet", ("orodispersible tablet", "odt", "mouth-dissolving tablet"), "orally disintegrating tablet"),
    "oral_tablet_chewable": ("oral", "tablet", ("chewable tablet", "chew tab"), "chewable tablet"),
    "oral_capsule": ("oral", "capsule", ("capsule", "cap", "oral capsule", "hard capsule", "hard gelatin capsule"), "capsule"),
    "oral_capsule_softgel": ("oral", "capsule", ("soft capsule", "softgel", "softgel capsule", "soft capsule, liquid-filled"), "capsule, liquid-filled"),
    "oral_solution": ("oral", "solution", ("oral solution", "oral drop", "oral drops", "oral soln"), "oral solution"),
    "nasal_spray": ("nasal", "spray", ("nasal spray", "nasal aerosol"), "nasal spray"),
    "nasal_solution": ("nasal", "solution", ("nasal solution", "nasal drops", "nasal drop"), "nasal solution"),
    "injectable_solution": ("injectable", "solution", ("injectable solution", "inj", "inject", "injection", "injection solution", "solution for injection", "solution for injection/infusion", "infusion"), "injectable solution"),
    "ophthalmic_solution": ("ophthalmic", "solution", ("ophthalmic solution", "ophthalmic drops", "ophthalmic drop", "eye solution", "eye drops", "eye drop", "oph soln", "soln oph", "oph solution", "oph drops", "oph drop", "ophthalmic soln"), "ophthalmic solution"),
    "otic_solution": ("otic", "solution", ("otic solution", "otic drops", "otic drop", "ear solution", "ear drops", "ear drop", "otic soln", "soln otic", "ear soln"), "otic solution"),
    "solution_unspecified": (None, "solution", ("solution", "drops", "drop"), "solution"),
    "oral_suspension": ("oral", "suspension", ("oral suspension", "suspension", "susp", "oral susp"), "oral suspension"),
    "oral_powder": ("oral", "powder", ("oral powder", "powder for oral solution", "powder for oral suspension"), "oral powder"),
    "powder_unspecified": (None, "powder", ("powder",), "powder"),
    "topical_powder": ("topical", "powder", ("topical powder", "cutaneous powder", "dermal powder", "dusting powder", "powder for topical", "powder for cutaneous", "powder for external use"), "topical powder"),
}

#: Fixed values. Words without meaning for similarity.
STOP_WORDS = ("and", "with", "of", "the", "to", "for", "in", "by", "per")
