"""Fixed values of the clinical preset: codes, names, patterns and limits that the results depend on.

They are data, kept as they are used, repeated and never-matching entries included: patterns with a blank before
the last ``%`` or with a capital letter, for instance, match nothing or little in lower-cased text.
"""

from __future__ import annotations

# --- codes and limits (fixed values) ---

BLOOD_CULTURE_SPECIMEN = 70012
DATA_SOURCE = "metavision"
PIPELINE_DRUG_TYPES = ("MAIN",)
DICTIONARY_DRUG_TYPES = ("MAIN", "ADDITIVE")
ROUTES = ("IV", "PO", "PO/NG", "ORAL", "IV DRIP", "IV BOLUS")
PREDICTION_HOURS = 8
OBSERVATION_HOURS = 24
SWEPT_PREDICTION_HOURS = (1, 2, 4, 6, 8)
CULTURE_THEN_DRUG_HOURS = 24.0
DRUG_THEN_CULTURE_HOURS = 72.0

# Items of vital signs (fixed values): item id to column name, in order of id.
VITAL_ITEMS = {
    220045: "heart_rate",
    220179: "systolic_pressure",
    220180: "diastolic_pressure",
    220210: "respiratory_rate",
    220277: "oxygen_saturation",
    220739: "gcs_eye",
    223761: "temperature_f",
    223900: "gcs_verbal",
    223901: "gcs_motor",
}

# Items made up for derived features (fixed values).
DERIVED_ITEMS = {1: "score", 2: "age", 3: "gender"}

# Points of the quick organ-failure score (fixed values): item, comparison, threshold.
SCORE_RULES = ((223900, "<", 15.0), (220179, "<=", 100.0), (220210, ">=", 22.0))

# --- drug names that count as antibiotics (fixed values) ---

ANTIBIOTICS = (
    "linezolid suspension", "ciprofloxacin iv", "sulfadiazine", "imipenem-cilastatin", "levofloxacin",
    "streptomycin sulfate", "nitrofurantoin macrocrystal", "moxifloxacin", "neo*iv*tobramycin sulfate",
    "amikacin inhalation", "azithromycin", "*nf* cefixime suspension", "vancomycin oral liquid",
    "ciprofloxacin in d5w", "colistin", "piperacillin sodium", "erythromycin ethylsuccinate suspension",
    "gentamicin", "sulfameth/trimethoprim", "sulfasalazine_", "clindamycin solution", "oxacillin", "erythromycin",
    "neo*iv*metronidazole", "amoxicillin-clavulanate susp", "neo*iv*oxacillin", "sulfasalazine",
    "quinupristin/dalfopristin", "*nf* cefotaxime", "tobramycin", "tobramycin sulfate",
    "neo*iv*piperacillin-tazobactam", "dicloxacillin", "amoxicillin trihydrate", "ciprofloxacin hcl",
    "vancomycin antibiotic lock", "polymyxin b sulfate", "metronidazole oral suspension",
    "neo*iv*penicillin g potassium", "azithromycin", "cefpodoxime proxetil", "demeclocycline hcl",
    "ampicillin sodium", "neo*iv*clindamycin", "paromomycin sulfate", "sulfameth/trimethoprim ss",
    "sulfameth/trimethoprim ds", "ciprofloxacin", "*nf* nafcillin sodium", "telavancin *nf*",
    "sulfamethoxazole/trimethoprim", "gentamicin sulfate", "moxifloxacin hcl", "amoxicillin oral susp.",
    "nitrofurantoin (macrodantin)", "penicillin v potassium", "*nf* moxifloxacin", "tigecycline",
    "nitrofurantoin monohyd (macrobid)", "*nf* ceftaroline", "*nf* ertapenem sodium", "demeclocycline",
    "gatifloxacin", "imipenem-cilastatin *nf*", "ampicillin", "dapsone", "erythromycin ethylsuccinate",
    "neo*iv*ceftriaxone", "isoniazid", "ampicillin sodium/sulbactam", "vancomycin enema", "rifabutin", "cefepime",
    "cefuroxime", "linezolid", "cefuroxime axetil", "aztreonam", "sulfamethoxazole-trimethoprim",
    "sulfasalazine dr", "daptomycin", "cefazolin", "nitrofurantoin", "piperacillin-tazobactam na",
    "neo*iv*vancomycin", "amoxicillin", "trimethoprim", "vancomycin", "nitrofurantoin suspension",
    "trimethoprim oral soln", "neo*iv*cefazolin", "cefuroxime sodium", "doxycycline hyclate", "bacitracin",
    "sulfasalazine ec", "sulfameth/trimethoprim", "clarithromycin", "clindamycin", "fosfomycin tromethamine",
    "doxycycline monohydrate", "ethambutol hcl", "neomycin sulfate", "chloramphenicol na succ", "rifaximin",
    "nafcillin sodium", "piperacillin-tazobactam", "erythromycin base", "ceftriaxone", "metronidazole",
    "penicillin g potassium", "piperacillin", "clindamycin suspension", "neo*iv*gentamicin", "nafcillin",
    "neo*po*azithromycin", "tetracycline hcl", "doripenem *nf*", "ceftaroline", "amikacin", "clindamycin phosphate",
    "pyrazinamide", "clindamycin hcl", "moxifloxacin", "neo*iv*erythromycin", "metronidazole (flagyl)", "meropenem",
    "ceftriaxone sodium", "cefadroxil", "paromomycin", "amoxicillin-clavulanic acid",
    "sulfameth/trimethoprim suspension", "doxycycline hyclate (periostat)", "neo*iv*ampicillin sodium",
    "amoxicillin-clavulanate susp.", "ampicillin-sulbactam", "erythromycin lactobionate", "neo*iv*cefotaxime",
    "vancomycin hcl",
)

# --- patterns that find antibiotics among lower-cased drug names (fixed values) ---

ANTIBIOTIC_PATTERNS = (
    "%amikacin%", "%gentamicin%", "%kanamycin%", "%neomycin%", "%netilmicin%", "%tobramycin%", "%paromomycin%",
    "%streptomycin%", "%spectinomycin%", "%geldanamycin%", "%herbimycin%", "%rifaximin%", "%loracarbef%",
    "%ertapenem%", "%doripenem%", "%Imipenem%", "%cilastatin%", "%meropenem%", "%cefadroxil%", "%cefazolin%",
    "%cefalexin%", "%cefaclor%", "%cefprozil%", "%cefuroxime%", "%cefixime %", "%cefdinir%", "%cefditoren%",
    "%cefoperazone%", "%cefotaxime%", "%cefpodoxime%", "%ceftazidime %", "%ceftibuten%", "%ceftriaxone%",
    "%cefepime%", "%ceftaroline%", "%ceftobiprole%", "%teicoplanin%", "%vancomycin%", "%telavancin%",
    "%dalbavancin%", "%oritavancin%", "%clindamycin%", "%lincomycin%", "%daptomycin%", "%azithromycin%",
    "%clarithromycin%", "%erythromycin%", "%roxithromycin%", "%telithromycin%", "%spiramycin%", "%aztreonam%",
    "%furazolidone%", "%nitrofurantoin%", "%linezolid%", "%posizolid%", "%radezolid%", "%torezolid %",
    "%amoxicillin%", "%ampicillin%", "%azlocillin%", "%dicloxacillin%", "%flucloxacillin%", "%mezlocillin %",
    "%methicillin%", "%nafcillin%", "%oxacillin%", "%penicillin%", "%piperacillin%", "%temocillin%",
    "%ticarcillin%", "%clavulanate%", "%sulbactam%", "%amoxicillin%", "%ampicillin%", "%sulbactam%",
    "%piperacillin%", "%tazobactam%", "%bacitracin%", "%colistin%", "%polymyxin%", "%ciprofloxacin%", "%enoxacin%",
    "%gatifloxacin%", "%gemifloxacin%", "%levofloxacin%", "%lomefloxacin%", "%moxifloxacin%", "%nadifloxacin%",
    "%nalidixic%", "%norfloxacin%", "%ofloxacin%", "%trovafloxacin%", "%grepafloxacin%", "%sparfloxacin%",
    "%temafloxacin%", "%mafenide%", "%sulfacetamide%", "%sulfadiazine%", "%sulfadimethoxine%", "%sulfamethizole%",
    "%sulfamethoxazole%", "%sulfanilimide%", "%sulfasalazine%", "%sulfisoxazole%", "%sulfonamidochrysoidine%",
    "%demeclocycline%", "%doxycycline%", "%metacycline%", "%minocyclinen%", "%oxytetracycline%", "%tetracycline%",
    "%clofazimine%", "%dapsone%", "%capreomycin%", "%cycloserine%", "%ethambutol%", "%ethionamide%", "%isoniazid%",
    "%pyrazinamide%", "%rifampicin%", "%rifabutin%", "%rifapentine%", "%streptomycin%", "%arsphenamine%",
    "%chloramphenicol%", "%fosfomycin%", "%fusidic%", "%metronidazole%", "%mupirocin%", "%platensimycin%",
    "%quinupristin%", "%dalfopristin%", "%thiamphenicol%", "%tigecycline%", "%tinidazole%", "%trimethoprim%",
)

# --- what the drug dictionary leaves out (fixed values) ---

EXCLUDED_ROUTE_PATTERNS = ("%ear%", "%eye%")
EXCLUDED_DRUG_PATTERNS = ("%cream%", "%desensitization%", "%ophth oint%", "%gel%")
EXCLUDED_DOSE_UNITS = ("Appl", "DROP")

# --- the dictionary of vital signs (fixed values) ---

VITAL_CATEGORIES = ("Routine Vital Signs", "Respiratory", "Neurological")
VITAL_LABEL_PATTERNS = (
    "%blood pressure%", "%heart rate%", "%respiratory rate%", "%pulseoxymetry%", "%temperature fahrenheit%",
    "%temperature celsius%", "%gcs%",
)
VITAL_RAW_LABEL_PATTERNS = ("%BP%", "%RR%")
EXCLUDED_VITAL_PATTERNS = ("%orthostatic%", "%>%")

# --- the dictionary of diagnoses (fixed values) ---

DIAGNOSIS_LONG_PATTERNS = ("%sepsis%", "%septicemia%", "%septicernia%", "%meningococcemia%")
DIAGNOSIS_SHORT_PATTERNS = ("%septic shock%",)
EXCLUDED_DIAGNOSIS_PATTERNS = ("%puerperal%", "%labor%", "%newborn%")
EXCLUDED_DIAGNOSES = ("herpetic septicemia", "anthrax septicemia")
