"""Fixed values of the audit: enumerations, patterns and word lists whose content results depend on."""

# The characters that Python's str.strip() removes.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Representations in report order, and those that ignore salt form or stereochemistry.
REPRESENTATIONS = ["raw_smiles", "canonical_smiles", "inchikey", "parent_inchikey", "inchikey_connectivity"]
SALT_INSENSITIVE = ["parent_inchikey"]
STEREO_INSENSITIVE = ["inchikey_connectivity"]

# Parse-failure patterns, in the syntax common to Java's and Python's regular expressions.
CONTROL_CHARACTERS = r"(?i)[\x00-\x1f\x7f]|<NL>|<CR>|<TAB>"
BRACKETED_NAME = r"^\[[A-Za-z][A-Za-z0-9 ,'\-]{4,}\]$"
FILLER_ONLY = r"^[#\-?.\s*]+$"
ATOM_LETTER = r"[BCNOPSFIbcnops]"
MARKUSH = r"\[R\d*'?\]|R(?![a-z])|\[n=\]|\(CH2\)n|\[[XYQAG]\]"
STOICHIOMETRY = r"\[\s*\d+\s*[./]\s*\d*[^\]]*\]"
PLACEHOLDERS = ["0", "na", "n/a", "nan", "none", "null", "nil", "-", "--", "?", ".", "not available"]
DANGLING_ENDS = ["(", "[", "=", "#", "/", "\\", "-", "@", ".", "%"]
TRUNCATION_LENGTHS = [255, 256, 1024, 4000, 32767]
PARSE_ERRORS = ["empty", "control_characters", "truncated", "placeholder", "markush", "stoichiometry_text", "valence", "kekulisation", "ring_closure", "processing", "other"]

# What pandas reads as missing in delimited text.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# Names that a structure column may have, in order of preference.
STRUCTURE_COLUMNS = ["smiles", "canonical_smiles", "standardized_smiles", "standardised_smiles", "std_smiles", "isomeric_smiles", "cxsmiles", "smi", "structure", "molecule", "mol"]

# Metals.
METALS = (
    "Li Na K Rb Cs Fr Be Mg Ca Sr Ba Ra Sc Ti V Cr Mn Fe Co Ni Cu Zn Y Zr Nb Mo Tc Ru Rh Pd Ag Cd Hf Ta W Re Os Ir Pt Au Hg "
    "Al Ga In Sn Tl Pb Bi Sb La Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Ac Th U Np Pu"
).split()

# Counterions of salts, compared neutral and without stereochemistry.
COUNTERIONS = [
    "Cl", "Br", "I", "F", "OS(=O)(=O)O", "OP(=O)(O)O", "O=[N+]([O-])O", "OCl(=O)(=O)=O", "F[B-](F)(F)F", "F[P-](F)(F)(F)(F)F", "[C-]#N",
    "OC=O", "CC(=O)O", "OC(=O)C(F)(F)F", "CS(=O)(=O)O", "Cc1ccc(S(=O)(=O)O)cc1", "CCS(=O)(=O)O", "OCCS(=O)(=O)O", "OS(=O)(=O)C(F)(F)F", "OC(=O)c1cc(S(=O)(=O)O)ccc1O",
    "OS(=O)(=O)c1ccccc1", "OS(=O)(=O)c1ccc2ccccc2c1", "CC1(C)C2CCC1(CS(=O)(=O)O)C(=O)C2", "OC(=O)C(=O)O", "OC(=O)C=CC(=O)O", "OC(=O)CCC(=O)O", "OC(=O)CC(O)C(=O)O",
    "OC(=O)C(O)C(O)C(=O)O", "OC(=O)CC(O)(CC(=O)O)C(=O)O", "CC(O)C(=O)O", "OC(=O)c1ccccc1", "OC(=O)c1cc2ccccc2c(Cc2c(O)c(C(=O)O)cc3ccccc23)c1O",
    "Oc1c(cc(cc1[N+](=O)[O-])[N+](=O)[O-])[N+](=O)[O-]", "N", "OCCN", "NC(CO)(CO)CO", "CNCC(O)C(O)C(O)C(O)CO", "C[N+](C)(C)CCO",
]

# Solvents of solvates.
SOLVENTS = ["O", "CO", "CCO", "CC(C)O", "CC(C)=O", "CC#N", "CS(C)=O", "CN(C)C=O", "CCOC(C)=O", "CCOCC", "C1CCOC1", "C1COCCO1", "ClCCl", "ClC(Cl)Cl", "Cc1ccccc1", "CCCCCC"]

# Small molecules that are no suspicious fragments.
SMALL_MOLECULES = ["CO", "CCO", "CC#N", "C=O", "CC=O", "O=CO", "NC=O", "CN", "CCN", "CNC", "COC", "C1CO1", "CC", "CCC", "C=C", "C=CC", "C#C", "CF", "CCl", "CBr", "CI", "ClCCl", "CS", "O=C=O", "S=C=S"]

# Quality categories in report order; the last two are totals without a finding type of their own.
QUALITY_FLAGS = ["salt_or_solvate", "contains_metal", "multi_component", "homodimer_without_counterion", "unclassified_mixture", "net_charge", "undefined_stereo", "suspicious_fragments", "smiles_whitespace", "rdkit_warnings", "mixtures", "salts_or_metal_complexes"]
QUALITY_TOTALS = ["mixtures", "salts_or_metal_complexes"]
QUALITY_FINDINGS = {q: {"suspicious_fragments": "suspicious_fragment", "rdkit_warnings": "rdkit_warning"}.get(q, q) for q in QUALITY_FLAGS if q not in QUALITY_TOTALS}

# Finding types by tier.
ALWAYS_FAIL = ["unparseable_smiles", "exact_overlap", "salt_form_overlap", "identifier_overlap", "one_id_multiple_structures", "homodimer_without_counterion"]
FAIL_IN_TEST = ["duplicate_structure", "duplicate_salt_form", "duplicate_identifier"]
ALWAYS_WARN = [
    "stereo_overlap", "inconsistent_smiles", "duplicate_stereoisomer", "one_id_structure_variants", "one_structure_multiple_ids", "identifier_whitespace", "identifier_near_duplicate",
    "id_with_unparseable_and_valid_structures", "missing_structure_resolvable_by_id", "net_charge", "salt_or_solvate", "contains_metal", "multi_component", "unclassified_mixture",
    "undefined_stereo", "suspicious_fragment", "smiles_whitespace", "rdkit_warning",
]
OVERLAP_FINDINGS = {"parent_inchikey": "salt_form_overlap", "inchikey_connectivity": "stereo_overlap"}
DUPLICATE_FINDINGS = {"parent_inchikey": "duplicate_salt_form", "inchikey_connectivity": "duplicate_stereoisomer"}
