"""What the SQL of the queries expects, stated apart from the operators: weights, patterns, letters, words of the queries.

Nothing here is taken from the modules that the SQL checks, so that a wrong value there does not agree with itself.
"""

from __future__ import annotations

# The letters before a type's name.
LETTERS = ("A", "U", "F", "E", "S", "I")

# What a kind adds to a type's score.
KIND_SQL = """case kind when 'class' then 0.04::double when 'struct' then 0.03::double when 'interface' then 0.03::double
    when 'enum' then 0.02::double when 'delegate' then 0.01::double when 'event' then 0.01::double else 0 end"""

# What a specifier adds to a member's score.
SPECIFIER_SQL = """case when contains(specifiers, 'BlueprintCallable') then 0.05::double else 0 end
    + case when contains(specifiers, 'BlueprintPure') then 0.05::double else 0 end
    + case when contains(specifiers, 'BlueprintReadWrite') then 0.04::double else 0 end
    + case when contains(specifiers, 'BlueprintReadOnly') then 0.04::double else 0 end
    + case when contains(specifiers, 'BlueprintImplementableEvent') then 0.04::double else 0 end
    + case when contains(specifiers, 'BlueprintNativeEvent') then 0.04::double else 0 end
    + case when contains(specifiers, 'EditAnywhere') then 0.03::double else 0 end
    + case when contains(specifiers, 'EditDefaultsOnly') then 0.02::double else 0 end
    + case when contains(specifiers, 'VisibleAnywhere') then 0.02::double else 0 end
    + case when contains(specifiers, 'Replicated') then 0.02::double else 0 end"""

# What a line that defines something begins with.
DEFINES = "|".join(
    (
        r"(?:^\s*(class|struct|enum)\s+\w+)",
        r"(?:^\s*UCLASS\s*\()",
        r"(?:^\s*USTRUCT\s*\()",
        r"(?:^\s*UENUM\s*\()",
        r"(?:^\s*UFUNCTION\s*\()",
        r"(?:^\s*UPROPERTY\s*\()",
        r"(?:^\s*UINTERFACE\s*\()",
        r"(?:^\s*(virtual\s+)?(void|int|float|bool|double|auto|const\s+\w+&?|[\w:]+\*?)\s+\w+::\w+\s*\()",
        r"(?:^\s*(void|int|float|bool|double|auto|FString|FName|FVector|TArray|TMap)\s+\w+\s*\()",
        r"(?:^\s*#define\s+\w+)",
        r"(?:^\s*(mixin\s+)?class\s+\w+)",
        r"(?:^\s*(event\s+|delegate\s+)?\w+\s+\w+\s*\()",
    )
)

#: The words of the queries that are asked, by camel case and without a type's letter.
WORDS = {"NightKayak": ["night", "kayak"], "UKayak": ["kayak"], "FrostLance": ["frost", "lance"], "AnchorHealth": ["anchor", "health"], "ApplyA": ["apply", "a"]}


def variants(name: str) -> list[str]:
    """All spellings with a letter before a name, or with another letter or none in place of the one it has."""
    spellings = {letter + name for letter in LETTERS}
    if name[0] in LETTERS:
        spellings |= {letter + name[1:] for letter in LETTERS} | {name[1:]}
    return sorted(spellings - {name})


def pieces(text: str) -> list[str]:
    """The distinct pieces of three characters of a query, which has no line ends."""
    low = text.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def least_shared(text: str) -> int:
    """Pieces a candidate must share: six in ten for up to 5 characters, three in four for up to 15, else four in five."""
    tenths = 12 if len(text) <= 5 else 15 if len(text) <= 15 else 16  # twentieths
    return max(2, -(-len(pieces(text)) * tenths // 20))
